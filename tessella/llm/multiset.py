"""Homomorphic fingerprints of documents as multisets of paragraphs.

A paragraph hashes to a wide vector, and a document to the sum of the vectors of its
paragraphs, modulo powers of two. Sums do not depend on order, and a paragraph can
be added or taken away without the rest of the text.

The vector has two parts. The exact part is the 256-bit BLAKE2b of the paragraph as
four lanes modulo 2^64: equal multisets have equal sums, and others differ but for
chance. The likeness part has 128 lanes modulo 2^32: each run of three words of
the paragraph adds +1 or -1 to one lane, both chosen by its hash. The cosine of two
such sums estimates how much of their runs two documents share, with a standard
error near 1/sqrt(128).

Paragraphs are the lines of a text. Defined cases: a NULL text counts as empty; a
text of one empty paragraph and an empty text are the same; equal texts have equal
fingerprints; two fingerprints without any word are alike (1) when equal and
unlike (0) otherwise; a lone document is its own next one; rows with equal ids are
ordered by their text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import hashing
from tessella.llm.columns import runs, utf8

LANES = 128
EXACT = 4
RUN = 3
U = np.uint64
BREAKS = np.zeros(256, bool)
BREAKS[0x0A] = True


def sums(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(exact lanes, likeness lanes) of every text, as unsigned sums."""
    data, at = utf8(texts)
    n = len(at) - 1
    start, end, row = hashing.tokens(data, at, BREAKS)
    exact = np.zeros((n, EXACT), U)
    if len(start):
        raw = data.tobytes()
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8 * EXACT).digest()
                           for a, b in zip(start.tolist(), end.tolist()))
        np.add.at(exact, row, np.frombuffer(digests, "<u8").reshape(-1, EXACT))
    likeness = np.zeros((n, LANES), np.int64)
    first, last, text = hashing.tokens(data, at)
    if len(first):
        paragraph = np.searchsorted(start, first, side="right") - 1  # a word lies in one
        value, owner = hashing.shingles(hashing.stretches(data, first, last), paragraph, RUN)
        where = row[owner] * LANES + (value & U(LANES - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((value >> U(32)) & U(1)).astype(np.float64)
        likeness += np.bincount(where, weights=sign, minlength=n * LANES).astype(np.int64).reshape(n, LANES)
    return exact, likeness.astype(np.uint32)


def add(a: tuple, b: tuple) -> tuple:
    """The fingerprint of both multisets together."""
    return a[0] + b[0], a[1] + b[1]


def remove(a: tuple, b: tuple) -> tuple:
    """The fingerprint of multiset a without b."""
    return a[0] - b[0], a[1] - b[1]


def spelled(prints: tuple[np.ndarray, np.ndarray]) -> list[str]:
    exact, likeness = prints
    return [base64.b64encode(x.astype("<u8").tobytes() + y.astype("<u4").tobytes()).decode()
            for x, y in zip(exact, likeness)]


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1: cosine of the likeness lanes, 1 for equal fingerprints."""
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(x)), where=norm > 0)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and `fingerprint`."""
    source = docs.select(*[docs[c] for c in keep or ["doc_id"]], docs[text].alias("_text"))
    names = [*source.columns[:-1], "fingerprint"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "_text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(spelled(sums(part.column("_text"))))],
                                                 names=names)
    return source.mapInArrow(work, f"{schema}, fingerprint string")


def edited(text: str, following: str) -> tuple[int, str]:
    """The text with its last third replaced by the start of the following one: (first
    code point that may differ, edited text)."""
    third = len(text) // 3
    keep = len(text) - third
    return keep, text[:keep] + following[:third]


def _in_descending_order(docs: DataFrame, text: str) -> DataFrame:
    """(_bucket, _ahead, doc_id, _text), sorted by descending id within buckets. Every
    bucket ends with the first document of the next one, marked `_ahead`; the last
    bucket with that of the first one.

    Buckets are ranges of the id between its quantiles, eight per shuffle partition;
    only these bounds and the buckets' numbers come to the driver."""
    spark = docs.sparkSession
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.array(*[F.lit(k / n) for k in range(1, n)])
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", share, F.lit(100 * n))).first()[0] or []))
    at = F.lit(-1)
    bucket = F.when(F.col("doc_id").isNull(), at).otherwise(
        F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("doc_id")))
        if bounds else F.lit(0))
    rows = docs.select(bucket.alias("_bucket"), "doc_id", F.coalesce(docs[text], F.lit("")).alias("_text"))
    heads = rows.groupBy("_bucket").agg(F.max("doc_id").alias("_id"))
    kept = sorted((r["_bucket"] for r in heads.select("_bucket").collect()), reverse=True)
    before = {b: kept[k - 1] for k, b in enumerate(kept)}  # the bucket that comes just before; cyclic
    ids = F.broadcast(spark.createDataFrame(list(before.items()), "_b int, _before int").join(
        heads, F.col("_b") == F.col("_bucket")).select("_b", "_before", "_id"))  # a row per bucket
    first = (rows.join(ids, (F.col("_bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_id")))
             .groupBy(F.col("_before").alias("_bucket")).agg(F.min(F.struct("_text", "doc_id")).alias("_s")))
    ahead = first.select("_bucket", F.lit(True).alias("_ahead"), "_s.doc_id", "_s._text")
    return (rows.select("_bucket", F.lit(False).alias("_ahead"), "doc_id", "_text").unionByName(ahead)
            .repartition("_bucket").sortWithinPartitions("_bucket", "_ahead", F.desc_nulls_last("doc_id"), "_text"))


def compare_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next): each document beside its edit by the next one in descending id.
    The edit's fingerprint is the document's without the paragraphs from the first
    changed one on, with the new ones added. Texts are shuffled once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in runs(batch, "_text"):
                rows = [c.to_pylist() for c in part.columns]
                if held is not None:
                    rows = [[a, *b] for a, b in zip(held, rows)]
                held = [c[-1] for c in rows]
                _, ahead, ids, texts = rows
                own = [k for k in range(len(ids) - 1) if not ahead[k]]
                if not own:
                    continue
                changed = [edited(texts[k], texts[k + 1]) for k in own]
                starts = [texts[k].rfind("\n", 0, keep) + 1 for k, (keep, _) in zip(own, changed)]
                whole = sums(pa.array(texts, pa.large_string()))
                old = sums(pa.array([texts[k][a:] for k, a in zip(own, starts)], pa.large_string()))
                new = sums(pa.array([t[a:] for (_, t), a in zip(changed, starts)], pa.large_string()))
                here = tuple(x[own] for x in whole)
                after = add(remove(here, old), new)
                following = tuple(x[np.array(own) + 1] for x in whole)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[k] for k in own], part.schema.field("doc_id").type),
                    pa.array([len(texts[k]) for k in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in changed]),
                    pa.array(spelled(here)), pa.array(spelled(after)),
                    pa.array(alike(here, after)), pa.array(alike(here, following))], names=names)

    return _in_descending_order(docs, text).mapInArrow(
        work, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
