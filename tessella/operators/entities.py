"""Entity spans: dictionaries, patterns, overlap resolution, merging, statistics.

Candidates, the order-dependent resolution and the merge all work on the spans
of one text inside its row (see functions.spans); only reports group rows. Resolution
and merge are sweeps over sorted spans, linear in their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.data import entities as ed
from tessella.functions import automaton as au
from tessella.functions import spans as sp
from tessella.functions import text as tx
from tessella.functions.rows import bind, settled, unnest
from tessella.operators.grams import gram_join

HAS_CJK = r"[\x{4e00}-\x{9fa5}]"
CJK_NEXT = "(?=[一-龥])"
"""Put before a pattern that begins with such a character but first looks back or tries many words."""


def name_array(names: list[tuple[str, str, float]]) -> Column:
    if not names:
        return F.expr("cast(array() as array<struct<name:string,type:string,confidence:double>>)")

    def text(w: str) -> str:
        return "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ", ".join(
        f"struct({text(n)} AS name, {text(t)} AS type, {float(c)!r}D AS confidence)"
        for n, t, c in names) + ")")


def span_rows(docs: DataFrame, key: str, spans: Column) -> DataFrame:
    return unnest(docs, [key], spans, "s").select(key, "s.*")


Names = list[tuple[str, str, float]]
HELD_NAMES = 500_000
"""Names up to which a table is held by every task."""


def gazetteer_spans(text: Column, names: Names) -> Column:
    """Spans of (name, type, confidence), name after name, each from left to right; one
    pass of an automaton finds them all."""
    words = au.Automaton(n for n, _, _ in names)
    place = {w: k for k, w in enumerate(words.words)}
    rows = sorted((place[n], k, kind, float(c)) for k, (n, kind, c) in enumerate(names) if n)
    word, rank = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    first = np.searchsorted(word, np.arange(len(place) + 1))
    texts_of, kinds = pa.array([words.words[w] for w in word], pa.string()), pa.array([r[2] for r in rows], pa.string())
    sure = np.array([r[3] for r in rows], np.float64)

    @F.arrow_udf(sp.SPAN)
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for run in au.runs(texts):
            codes, begins = au.characters(run)
            start, hit = words.find(codes)
            n = first[hit + 1] - first[hit]
            row = np.repeat(first[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(start, n)
            of = np.searchsorted(begins, start, side="right") - 1
            order = np.lexsort((start, rank[row], of))
            row, of, at = row[order], of[order], (start - begins[of])[order]
            out.append(sp.lists(len(run), of, [pa.array(at), pa.array(at + words.length[word[row]]), texts_of.take(pa.array(row)),
                                               kinds.take(pa.array(row)), pa.array(sure[row])], sp.ARROW))
        return pa.concat_arrays(out) if out else pa.array([], sp.ARROW)
    return find(text)


def gazetteer_entities(docs: DataFrame, key: str, gazetteer: DataFrame, text: str = "text") -> DataFrame:
    """(key, start, end, text, type, confidence) for a (name, type, confidence) table of
    any size (see grams)."""
    hit = gram_join(docs, key, gazetteer.select("name", "type", "confidence"), "name", text)
    return hit.select(key, "start", (F.col("start") + F.length("name")).cast("int").alias("end"),
                      F.col("name").alias("text"), "type", "confidence")


def time_spans(text: Column) -> Column:
    """Dates, clock times and bare years; the length rule of 1 to 25 applies."""
    cjk = lambda p: any("一" <= ch <= "龥" for ch in p)
    zh = F.concat(*[sp.of_pattern(text, tx.ahead(p), "TIME", v, p) for p, v in ed.TIME_PATTERNS if cjk(p)])
    plain = [sp.of_pattern(text, tx.ahead(p), "TIME", v, p) for p, v in ed.TIME_PATTERNS if not cjk(p)]
    found = F.concat(F.when(text.rlike(HAS_CJK), zh).otherwise(sp.none()), *plain)
    return F.filter(found, lambda s: F.length(s["text"]) <= 25)


def suffix_spans(text: Column) -> Column:
    """Organisations and places by their last characters."""
    parts = []
    for pattern, kind, confidence, shortest in ed.SUFFIX_PATTERNS:
        parts.append(F.filter(sp.of_pattern(text, CJK_NEXT + pattern, kind, confidence),
                              lambda s, m=shortest: F.length(s["text"]).between(m, 20)))
    return F.when(text.rlike(HAS_CJK), F.concat(*parts)).otherwise(sp.none())


def person_spans(text: Column) -> Column:
    """Name with title, short title, quoted speaker, title before a name."""
    surname = f"^[{ed.SURNAMES}]"
    suffixes = F.filter(F.array(*[F.lit(s) for s in ed.PERSON_SUFFIXES]), lambda s: F.contains(text, s))

    def titled(s: Column) -> Column:
        pattern = F.concat(F.lit(CJK_NEXT + r"(?<![一-龥])[一-龥]{1,3}\Q"), s, F.lit(r"\E"))
        hits = F.filter(sp.matches(text, pattern), lambda m: F.length(m["text"]).between(2, 8)
                        & (m["text"].rlike(surname) | (F.length(m["text"]) - F.length(s) >= 2)))
        return F.transform(hits, lambda m: sp.span(m["start"], m["text"], F.lit("PER"), F.when(
            m["text"].rlike(surname), 0.88).otherwise(0.82)))
    with_title = F.flatten(F.transform(suffixes, titled))
    short = sp.of_pattern(text, rf"{CJK_NEXT}(?<![一-龥a-zA-Z])[{ed.SURNAMES}][{ed.SHORT_TITLES}](?![一-龥])", "PER", 0.86)

    def inner(pattern: str, group: int, offset, confidence: float, keep) -> Column:
        named = F.transform(sp.matches(text, pattern), lambda m: sp.span(
            m["start"] + offset(m["text"]), F.regexp_extract(m["text"], pattern, group),
            F.lit("PER"), F.lit(confidence)))
        return F.filter(named, keep)
    speaker = inner(rf"[，。！？；：\s]([一-龥]{{2,3}})({ed.SPEECH})", 1, lambda t: F.lit(1), 0.86,
                    lambda s: s["text"].rlike(surname))
    before = rf"{CJK_NEXT}({ed.TITLES})([一-龥]{{2,3}})([，。！？；：\s说表示]|$)"
    office = inner(before, 2, lambda t: F.length(F.regexp_extract(t, before, 1)), 0.84,
                   lambda s: F.length(s["text"]) >= 2)
    return F.when(text.rlike(HAS_CJK), F.concat(with_title, short, speaker, office)).otherwise(sp.none())


def quick_org() -> str:
    """ENGLISH_ORG in either case: the letters that fold to a-z are named instead of folding every
    character, words and white space are never given back (nothing else could follow
    them), endings are told apart by their first letter."""
    head = ed.ENGLISH_ORG.rsplit(r"\s+(?:", 1)[0]
    head = head.replace("[A-Z][a-zA-Z", rf"[a-zA-Z\x{{131}}\x{{17f}}][a-zA-Z{FOLDED}").replace("]+", "]++").replace(r"\s+", r"\s++")
    return rf"{head}\s++{org_ending()}"


def org_ending() -> str:
    """What ends ENGLISH_ORG, in either case. Few texts hold it, and finding that out is one try a word."""
    endings = ed.ENGLISH_ORG.rsplit(r"\s+(?:", 1)[1].removesuffix(r")\b")
    return rf"(?iu:{tx.first_letters(endings)})\b"


FOLDED = r"\x{130}\x{131}\x{17f}\x{212a}"
"""Letters that Java takes for one of a-z when case is ignored, in Unicode; of these, two for one of A-Z."""


def english_spans(text: Column) -> Column:
    """Known organisations, titled names, names, organisation and place endings,
    times. A later pattern yields to any earlier hit it overlaps: a fold over the
    list of stages, each an array of spans."""
    orgs = [(n, "ORG", 0.92) for n in ed.ENGLISH_ORGS]
    words = lambda lo, hi: lambda s: sp.word_count(s["text"]).between(lo, hi)
    stages = [
        (ed.ENGLISH_TITLED, "PER", 0.88, None),
        (ed.ENGLISH_NAME, "PER", 0.85, words(2, 3)),
        (quick_org(), "ORG", 0.82, words(3, 6)),
        (tx.by_first(ed.ENGLISH_LOCATION), "LOC", 0.80, words(2, 5)),
        *[(p, "TIME", v, None) for p, v in ed.ENGLISH_TIMES],
    ]
    found = []
    for pattern, kind, confidence, keep in stages:
        spans = sp.of_pattern(text, tx.ahead(pattern), kind, confidence, pattern)
        if kind == "ORG":
            spans = F.when(text.isNull() | text.rlike(r"\s" + org_ending()), spans).otherwise(sp.none())
        found.append(F.filter(spans, keep) if keep else spans)
    return F.aggregate(F.array(*found), sp.of_names(text, name_array(orgs)),
                       lambda kept, new: F.concat(kept, sp.not_touching(new, kept)))


def postprocess(spans: Column, text: Column) -> Column:
    """Bounds, blanks, length, script and confidence rules."""
    def keep(s: Column, size: Column) -> Column:
        body, kind = s["text"], s["type"]
        return ((s["start"] >= 0) & (s["end"] <= size) & (s["end"] > s["start"])
                & body.rlike(tx.NON_SPACE) & ((F.length(body) <= 30) | kind.isin("ORG", "LOC"))
                & (~kind.isin("ORG", "LOC", "NOUN") | body.rlike(r"[\x{4e00}-\x{9fa5}a-zA-Z]")))

    def bounded(s: Column) -> Column:
        c = s["confidence"]
        low = 0.5 + F.least(F.lit(0.4), F.length(s["text"]) * 0.015)
        return sp.span(s["start"], s["text"], s["type"], F.least(F.lit(0.99), F.when(c < 0.5, low).otherwise(c)))
    kept = bind(F.length(text), lambda size: F.filter(spans, lambda s: keep(s, size)))  # measured once a text
    return F.transform(kept, bounded)


def _sweep(of: np.ndarray, columns: list[pa.Array]) -> np.ndarray:
    """Places of the spans that stay, text after text. Earliest first, longer first, surer
    first; of overlapping spans the later one replaces the last kept one or goes. A stack of
    what is kept, so as much work as there are spans; spans that overlap none just stay."""
    start, end, sure = (np.asarray(columns[i]).astype(t) for i, t in ((0, np.int64), (1, np.int64), (4, np.float64)))
    order = np.lexsort((-sure, start - end, start, of))
    own = of[order].astype(np.int64) << 33
    upto = np.maximum.accumulate(own + end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (own[1:] + start[order][1:] >= upto[:-1]) | (own[1:] != own[:-1])
    last = np.append(fresh[1:], True)
    alone = fresh & last
    among = order[~alone]
    body, kind = columns[2].take(pa.array(among)), columns[3].take(pa.array(among))
    a, b, c = start[among].tolist(), end[among].tolist(), sure[among].tolist()
    size, kinds = np.asarray(pc.utf8_length(body)).tolist(), kind.to_pylist()
    weak = pc.is_in(pc.utf8_slice_codeunits(body, 0, 1), pa.array(ed.WEAK_PLACE_PREFIX)).to_pylist()

    def replaces(e: int, p: int) -> bool:
        gap, kept = c[e] - c[p], b[p] - a[p]
        return (gap > 0.10 or kept <= 2 or kinds[p] == "LOC" and weak[p]
                or kinds[e] == "PER" and kinds[p] == "LOC" and size[e] <= 4 and c[e] >= 0.85
                or kinds[e] == "TIME" and kinds[p] != "TIME" and c[e] >= 0.90
                or b[e] - a[e] > kept * 1.5 and gap > -0.05)
    stay: list[int] = []
    for e, first in enumerate(fresh[~alone].tolist()):
        if first or a[e] >= b[stay[-1]]:
            stay.append(e)
        elif replaces(e, stay[-1]):
            stay[-1] = e
    kept = np.concatenate([order[alone], among[np.array(stay, np.int64)]])
    return kept[np.lexsort((start[kept], of[kept]))]


def _joined(of: np.ndarray, columns: list[pa.Array], texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Neighbours of one type with nothing but a joiner between them become one span. Spans lie in their texts."""
    start, end, sure = (np.asarray(columns[i]) for i in (0, 1, 4))
    kind = np.asarray(columns[3].dictionary_encode().indices)
    gap = start[1:] - end[:-1]
    near = np.flatnonzero((of[1:] == of[:-1]) & (kind[1:] == kind[:-1]) & (gap >= 1) & (gap <= 2)) + 1
    first = np.ones(len(of), bool)
    held, text = -1, ""
    for i, t, a, b in zip(near.tolist(), of[near].tolist(), end[near - 1].tolist(), start[near].tolist()):
        if t != held:
            held, text = t, texts[t].as_py()
        first[i] = text is None or text[a:b].strip(" ") not in ed.JOINERS
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(of)) - 1
    sure, many, bodies, held = sure.copy(), tails > heads, [], -1
    for h, z, t in zip(heads[many].tolist(), tails[many].tolist(), of[heads[many]].tolist()):
        if t != held:
            held, text = t, texts[t].as_py()
        bodies.append(text[start[h]:end[z]])
        for i in range(h + 1, z + 1):
            sure[h] = (sure[h] + sure[i]) / 2
    at = pa.array(heads)
    body = pc.replace_with_mask(columns[2].take(at), pa.array(many), pa.array(bodies, columns[2].type))
    return of[heads], [columns[0].take(at), pa.array(end[tails]), body, columns[3].take(at), pa.array(sure[heads])]


def resolve_overlaps(spans: Column) -> Column:
    @F.arrow_udf(sp.SPAN)
    def sweep(column: pa.Array) -> pa.Array:
        of, columns = sp.fields(column)
        stay = _sweep(of, columns) if len(of) else of
        return sp.lists(len(column), of[stay], [c.take(pa.array(stay)) for c in columns], sp.ARROW, column.is_null())
    return sweep(spans)


def merge_adjacent(spans: Column, text: Column) -> Column:
    @F.arrow_udf(sp.SPAN)
    def merge(column: pa.Array, texts: pa.Array) -> pa.Array:
        of, columns = sp.fields(column)
        if len(of):
            of, columns = _joined(of, columns, texts)
        return sp.lists(len(column), of, columns, sp.ARROW, pc.or_(column.is_null(), texts.is_null()))
    return merge(spans, text)


def candidates(text: Column, named: Column) -> Column:
    """Spans of all kinds; named: those of the gazetteer."""
    english = F.when(tx.language_by_majority(text) == "english", english_spans(text)).otherwise(sp.none())
    return F.concat(named, time_spans(text), suffix_spans(text),
                    person_spans(text), english)


def with_candidates(docs: DataFrame, key: str, names: DataFrame | Names, text: str = "text",
                    held_names: int = HELD_NAMES) -> DataFrame:
    """Adds `candidates`. Names are a list or a (name, type, confidence) table; one of more
    than `held_names` rows is joined, and a text's hits return to its row by key."""
    t = F.col(text)
    if isinstance(names, DataFrame):
        names = names.where("name <> ''").select("name", "type", F.col("confidence").cast("double").alias("confidence"))
        rows = names.limit(held_names + 1).collect()
        if len(rows) > held_names:
            hits = gazetteer_entities(docs, key, names, text).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(
                F.struct("start", "end", "text", "type", "confidence"))).alias("_named"))
            rows = docs.join(hits, F.col(key) == F.col("_key"), "left").drop("_key")
            return settled(rows, "candidates", candidates(t, F.coalesce("_named", sp.none()))).drop("_named")
        names = [tuple(r) for r in rows]
    rows = settled(docs, "_named", gazetteer_spans(t, [n for n in names if n[0]]))
    return settled(rows, "candidates", candidates(t, F.coalesce("_named", sp.none()))).drop("_named")


def recognize(docs: DataFrame, key: str, names: DataFrame | Names, text: str = "text", held_names: int = HELD_NAMES) -> DataFrame:
    """Adds `entities`, the final spans of each text."""
    t = F.col(text)
    rows = with_candidates(docs, key, names, text, held_names)
    rows = settled(rows, "_posted", postprocess(F.col("candidates"), t))
    rows = settled(rows, "_kept", resolve_overlaps(F.col("_posted")))
    rows = settled(rows, "_merged", merge_adjacent(F.col("_kept"), t))
    return settled(rows, "entities", postprocess(F.col("_merged"), t)).drop("candidates", "_posted", "_kept", "_merged")


def entity_rows(recognized: DataFrame, key: str) -> DataFrame:
    return span_rows(recognized, key, F.col("entities"))


def entity_stats(rows: DataFrame, key: str) -> DataFrame:
    """Spans per type and in all, zero-filled, for texts with any span."""
    return rows.groupBy(key).agg(
        *[F.count_if(F.col("type") == t).alias(t) for t in ed.TYPES], F.count("*").alias("total"))


def highlight(recognized: DataFrame, text: str = "text") -> Column:
    """The text with its spans in markup: untouched pieces and wrapped spans
    alternate from left to right."""
    @F.arrow_udf("string")
    def marked(texts: pa.Array, spans: pa.Array) -> pa.Array:
        of, columns = sp.fields(spans)
        begins = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
        out: list[str | None] = []
        for t, (whole, none) in enumerate(zip(texts, spans.is_null().to_pylist())):
            whole = whole.as_py()
            if whole is None or none:
                out.append(None)
                continue
            at, parts = 0, []
            for start, end, body, kind, sure in zip(*(c.slice(begins[t], begins[t + 1] - begins[t]).to_pylist() for c in columns)):
                label = ed.TYPES[kind]
                parts += [whole[at:start], f'<span class="entity-highlight entity-{kind.lower()}" title="{label}: {round(sure * 100)}%">'
                          f"{body}<sub>{label}</sub></span>"]
                at = end
            out.append("".join(parts) + whole[at:])
        return pa.array(out, pa.string())
    return marked(F.col(text), F.col("entities"))


def hit_rate(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, type, text) expected against found spans: a hit when either text
    contains the other. One row per case plus the total under a NULL key."""
    f = found.select(key, "type", F.col("text").alias("found")).distinct()
    e = expected.withColumn("_id", F.struct(key, "type", "text"))
    hit = e.join(f, [key, "type"]).where(F.contains("found", F.col("text")) | F.contains("text", F.col("found")))
    flags = e.join(hit.select("_id").distinct().withColumn("hit", F.lit(1)), "_id", "left")
    return flags.rollup(key).agg(F.count("hit").alias("hits"), F.count("*").alias("expected")).withColumn(
        "rate", F.col("hits") / F.col("expected"))
