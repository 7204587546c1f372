"""Deleting blocks of lines that a document shares with an earlier one, by pairwise
alignment.

Documents are ordered by (doc_id, hash of the text). From every line that is not blank
goes the shortest run of consecutive lines with `least_words` words or more, and to
every such line another one; a line of that many words is a run by itself. Documents
overlap where they share a run, and rare runs choose whom a document is aligned with: a
run that at most `RARE` places hold pairs every later document that holds it with the
first one. A frequent run says little about its holders; it makes a pair with its first
holder only for documents in which the alignments that rare runs asked for have left it
standing. As runs make one pair each, a run may be in any number of documents, and there
are never more than two pairs a line.

Each pair is aligned by patience diff on line hashes: lines that occur once on both sides
and ascend on both sides anchor the alignment, equal neighbours extend it, and the gaps
between anchors are aligned the same way. Aligned blocks, consecutive on both sides and
with `least_words` words or more in total, are deleted from the later document. What is
left is aligned again with the same earlier text, for blocks that moved. Where repeated
lines leave no unique one, whole runs anchor blocks of their own: a run is aligned where
it stands in the earlier text, rarest first, and extended as far as both sides agree; so
in the end no block is left. The first holder of a run is never later than itself, so one
copy of every block stays in the corpus.

A word is a stretch without white space; in scripts written without spaces (Chinese,
Japanese, Thai, Lao, Khmer, Burmese) every character counts as one.

Lines are split at line feeds, compared without white space around them, and joined
again by line feeds. Defined cases: a NULL text stays NULL, an empty one empty; rows
with equal id and text are one document and treated alike; rows with equal ids and
other texts are ordered by the hash; NULL ids come first; blank lines belong to a
block only between or beside aligned lines; an empty table gives an empty result;
further columns pass through unchanged.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import lists, utf8
from tessella.llm.hashing import SPACE
from tessella.session import cut

LEAST_WORDS = 5
RARE = 16
BATCH = 1024
SPACES = " \t\n\x0b\f\r"
NO_SPACES = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = regex.compile(rf"[{NO_SPACES}]|[^\x20\x09-\x0D{NO_SPACES}]+")
LEADS = np.isin(np.arange(256), [0xE0, 0xE1, 0xE2, 0xE3, *range(0xE4, 0xEA), 0xEF, 0xF0])
"""First bytes of characters of which some belong to these scripts."""
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence, of pairs with ascending firsts, whose seconds ascend."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        tails[at:at + 1] = [y]
        ends[at:at + 1] = [k]
        back[k] = ends[at - 1] if at else -1
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        here, there = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if there[x] == 1}
        anchors = _rising([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if here[x] == 1 and x in place])
        if not anchors:
            continue
        # Every anchor starts the part up to the next one; the prefix rule above aligns it.
        starts = [(a0, b0), *anchors]
        stops = [*anchors, (a1, b1)]
        todo += [(i, k, j, m) for (i, j), (k, m) in zip(starts, stops)]
    return sorted(out)


def enough(hashes: np.ndarray, words: np.ndarray, ends: np.ndarray, least_words: int,
           blank: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, last line, hash) of the shortest runs of enough words from and to each
    line, if it is not blank or `blank` is set. The lines of several documents follow each other; `ends`
    holds the end of its document for each line. The hash of one line is its own."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    total = np.cumsum(words, dtype=np.int64)
    before = total - words
    line = np.arange(n)
    last = np.searchsorted(total, before + least_words)
    forth = ((words > 0) | blank) & (last < ends)
    first = np.searchsorted(before, total - least_words, "right") - 1
    back = ((words > 0) | blank) & (first >= 0)
    back[back] = ends[first[back]] == ends[back]
    back[back] = last[first[back]] != line[back]  # found from its first line already
    start = np.concatenate([line[forth], first[back]])
    stop = np.concatenate([last[forth], line[back]])
    power = np.full(n, BASE, np.uint64)
    inverse = np.full(n, BASE_INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.astype(np.int64).view(np.uint64) * np.cumprod(power))])
    return start, stop, ((sums[stop + 1] - sums[start]) * np.cumprod(inverse)[start]).view(np.int64)


def anchored(later: list[int], earlier: list[int], words: list[int], least_words: int, gone: set[int]) -> Iterator[range]:
    """Blocks of `later` around runs of enough words that `earlier` holds and of which
    something is not gone, rarest runs first."""
    of = dict(zip(later, words))  # a run with a line that only `earlier` has is in no later text, whatever its words

    def runs(lines: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([of.get(x, least_words) for x in lines], np.int64)
        return enough(np.array(lines, np.int64), n, np.full(len(lines), len(lines)), least_words, blank=True)
    start, stop, key = runs(later)
    there, _, keys = runs(earlier)
    order = np.argsort(keys, kind="stable")
    there, keys = there[order], keys[order]
    first, last = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
    shared = np.flatnonzero(last > first)
    for k in shared[np.argsort((last - first)[shared], kind="stable")].tolist():
        i, m, j = int(start[k]), int(stop[k]) + 1, int(there[first[k]])
        if all(x in gone for x in range(i, m)):
            continue
        n = j + m - i
        while i > 0 and j > 0 and i - 1 not in gone and later[i - 1] == earlier[j - 1]:
            i, j = i - 1, j - 1
        while m < len(later) and n < len(earlier) and m not in gone and later[m] == earlier[n]:
            m, n = m + 1, n + 1
        yield range(i, m)


def aligned(rest: list[int], later: list[int], earlier: list[int], words: list[int], least_words: int) -> list[int]:
    """Lines of `later` in the blocks of one alignment of its places `rest` with `earlier`."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*((rest[k], j) for k, j in patience([later[k] for k in rest], earlier)), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[k] for k in block) >= least_words:
                out += block
            block = []
        block.append(i)
        before = (i, j)
    return out


def deleted_places(later: list[int], earlier: list[int], words: list[int], least_words: int, gone: Iterable[int] = ()) -> list[int]:
    """Lines of `later` in blocks that it shares with `earlier`: those of an alignment, of
    another one of what that leaves, and around runs that remain. Lines already gone are
    not aligned."""
    gone, held = set(gone), set(earlier)
    out: set[int] = set()
    for _ in range(2):
        rest = [k for k in range(len(later)) if k not in gone]
        if not any(later[k] in held for k in rest):
            return sorted(out)
        found = aligned(rest, later, earlier, words, least_words)
        if not found:
            break
        gone.update(found)
        out.update(found)
    if any(x in held and k not in gone for k, x in enumerate(later)):
        for block in anchored(later, earlier, words, least_words, gone):
            out.update(block)
            gone.update(block)
    return sorted(out)


def count_words(lines: pa.Array) -> np.ndarray:
    data, at = utf8(lines)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins = np.zeros(len(data) + 1, np.int64)
    begins[1:] = np.cumsum(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1])) if len(data) else 0
    out = begins[at[1:]] - begins[at[:-1]]
    radical = (data != 0xE2) | (np.append(data[1:], 0) >= 0xBA)  # else it is punctuation or a sign
    lead = np.concatenate(([0], np.cumsum(LEADS[data] & radical)))
    for k in np.flatnonzero(lead[at[1:]] > lead[at[:-1]]).tolist():
        out[k] = sum(1 for _ in WORD.finditer(lines[k].as_py()))
    return out


def sequences_of(docs: DataFrame, text: str) -> DataFrame:
    """(doc, hashes, words): the lines of every text that has any, a row per document."""
    did = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    lines = docs.where(F.length(docs[text]) > 0).select(
        did.alias("did"), F.xxhash64(docs[text]).alias("tid"), F.transform(_lines(docs[text]), lambda x: F.btrim(x, F.lit(SPACES))).alias("_l"))
    lines = lines.select("did", "tid", F.transform("_l", lambda x: F.xxhash64(x)).alias("hashes"), "_l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                size = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                words = lists(count_words(part.column(3).flatten()), size, pa.int32())
                doc = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["did", "tid"])
                yield pa.RecordBatch.from_arrays([doc, part.column(2), words], names=["doc", "hashes", "words"])
    return lines.mapInArrow(count, "doc struct<did:long,tid:long>, hashes array<long>, words array<int>")


def run_rows(lines: DataFrame, least_words: int) -> DataFrame:
    """(doc, run, start, stop): the runs of every document."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                size = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                ends = np.repeat(np.cumsum(size), size)
                owner = np.repeat(np.arange(part.num_rows), size)
                own = (np.cumsum(size) - size)[owner]
                start, stop, key = enough(part.column(1).flatten().to_numpy(zero_copy_only=False),
                                          part.column(2).flatten().to_numpy(zero_copy_only=False), ends, least_words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner[start])), pa.array(key), pa.array((start - own[start]).astype(np.int32)),
                     pa.array((stop - own[start]).astype(np.int32))], names=["doc", "run", "start", "stop"])
    return lines.mapInArrow(runs, "doc struct<did:long,tid:long>, run long, start int, stop int")


def align(pairs: DataFrame, lines: DataFrame, least_words: int) -> DataFrame:
    """(did, tid, places): what the alignments of pairs (doc, first, gone) delete."""
    # Rows equal in id and text are one document.
    sequences = lines.groupBy("doc").agg(F.first(F.struct("hashes", "words")).alias("_s"))
    earlier = sequences.select(F.col("doc").alias("first"), F.col("_s.hashes").alias("earlier"))
    later = sequences.select("doc", F.col("_s.hashes").alias("later"), F.col("_s.words").alias("words"))
    both = pairs.join(later, "doc").join(earlier, "first").select(
        F.col("doc.did").alias("did"), F.col("doc.tid").alias("tid"), "later", "words", "earlier", "gone")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = [deleted_places(a.tolist(), b.tolist(), w.tolist(), least_words, g.tolist())
                      for a, b, w, g in zip(batch["later"], batch["earlier"], batch["words"], batch["gone"])]
            yield pd.DataFrame({"did": batch["did"], "tid": batch["tid"], "places": places})[[bool(p) for p in places]]
    return both.mapInPandas(work, "did long, tid long, places array<int>")


def joined_places(places: DataFrame) -> DataFrame:
    return places.groupBy("did", "tid").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def duplicate_lines(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, rare: int = RARE) -> DataFrame:
    """(did, tid, places array<int>): the lines to delete, for documents that have some;
    did is the document id, tid the hash of its text."""
    lines = cut(sequences_of(docs, text))
    each = run_rows(lines, least_words)
    # Written on its own: a join of two shuffled sides can be split where a run is frequent.
    first = cut(each.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("_last"), F.count("*").alias("often"))
                .where("first < _last").drop("_last"))
    shared = each.join(first, "run").where(F.col("doc") != F.col("first"))
    pairs = cut(shared.groupBy("doc", "first").agg(
        F.min("often").alias("rarest"), F.collect_set(F.struct("start", "stop")).alias("runs")))
    none = F.expr("cast(array() as array<int>)")
    chosen = cut(joined_places(align(pairs.where(F.col("rarest") <= rare).select("doc", "first", none.alias("gone")), lines, least_words)))
    done = chosen.select(F.struct("did", "tid").alias("_doc"), F.col("places").alias("_places"))
    whole = lambda r: F.size(F.array_except(F.sequence(r["start"], r["stop"]), F.col("gone"))) == 0
    open_ = (pairs.where(F.col("rarest") > rare).join(done, F.col("doc") == F.col("_doc"), "left")
             .withColumn("gone", F.coalesce("_places", none)).where(~F.forall("runs", whole)))
    return joined_places(chosen.unionByName(align(open_.select("doc", "first", "gone"), lines, least_words)))


def dedup(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, count: str | None = None) -> DataFrame:
    """docs with the aligned lines gone from `text`; `count` names a column for how
    many went."""
    places = duplicate_lines(docs, text, least_words).select(
        F.col("did").alias("_did"), F.col("tid").alias("_tid"), "places")
    own = F.col("doc").getField(text)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                       F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("did"),
                       F.xxhash64(docs[text]).alias("tid"))
    joined = rows.join(places, (F.col("did") == F.col("_did")) & (F.col("tid") == F.col("_tid")), "left")
    kept = F.array_join(F.filter(_lines(own), lambda _, k: ~F.array_contains("places", k)), "\n")
    columns = [(F.when(F.col("places").isNull(), own).otherwise(kept) if c == text else F.col("doc").getField(c)).alias(c)
               for c in docs.columns]
    gone = [F.coalesce(F.size("places"), F.lit(0)).cast("long").alias(count)] if count else []
    return joined.select(*columns, *gone)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_deleted, text): every document with what is left of it."""
    return dedup(docs.select("doc_id", "text"), count="n_deleted").select("doc_id", "n_deleted", "text")
