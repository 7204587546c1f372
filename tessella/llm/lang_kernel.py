"""Language of texts by string kernels.

The kernel of two texts is the cosine of their blended spectrum: the sets of byte
n-grams of 1, 2 and 3 that are present, case folded and non-letters of ASCII as one
space. Some training texts are landmarks; every text is described by its kernels
with them (Nyström), in which a ridge regression per language separates that
language (+1) from the rest (-1). As the kernel is a product of presence vectors,
landmarks and regressions fold into one matrix, and a batch is scored by
presence matrix times that matrix. Only n-grams of landmarks count.

The classifier is fitted on at most `PER_LANGUAGE` rows of each label, those of
lowest id hash; the first `LANDMARKS` of them are landmarks. Everything is predicted.

`known` keeps texts in one of the languages. The score alone does not tell: a text that
shares nothing with any landmark has the middle score. So the n-grams of 3 with a letter
are counted, and how many of them a landmark has. The least score and the least share
are low quantiles of the training rows that are answered right, less a margin;
a landmark's own n-grams count for it only if another landmark has them. A share has
three standard deviations of slack and the n-grams of one long token (a key, a hash), so short
texts go on clear evidence only; a text with such n-grams of which no landmark has any goes. A text in which another language or script
takes more than about the margin goes as well.

Defined cases: a text that is NULL or has no letter is `und` with score 0; without
labelled rows so is every text; a text that shares no n-gram with a landmark gets
score 1/2 of the first label at most; long texts are read whole; equal texts get
equal answers; ties go to the first label in order; a NULL id is never trained on nor
held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.columns import lists, runs, utf8

PER_LANGUAGE = 400
LANDMARKS = 32
RIDGE = 1e-2
FOLDS = 5
NONE = "und"
LOW_QUANTILE = 0.01
SCORE_MARGIN = 0.25
SHARE_MARGIN = 0.1
SLACK = 3.0
TOKEN = 24
RUN_BYTES = 1 << 19

FOLD = np.full(256, 0x20, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
GRAMS = (1, 2, 3)
BASE = np.cumsum([0, 1 << 8, 1 << 16, 1 << 24])
BLANK = BASE[2] + 0x202020


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram id, text) of every place, for each length in turn."""
    data, at = utf8(column)
    low = FOLD[data]
    # U+00C0..U+00DE are 0xC3 0x80..0x9E; their small letters lie 0x20 above.
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    low[second & (data >= 0x80) & (data <= 0x9E)] += 0x20
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    value = low.astype(np.int64)
    for k in range(len(GRAMS)):
        if k:
            value = (value[:-1] << 8) | low[k:]
            inside = owner[:-k] == owner[k:]
            yield value[inside] + BASE[k], owner[:-k][inside]
        else:
            yield value, owner


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Vocabulary of landmark n-grams, and a score per n-gram and language."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, labels: list[str],
                 least_score: float = 0.0, least_share: float = 0.0):
        self.vocabulary, self.weights, self.labels = vocabulary, weights, labels
        self.least_score, self.least_share = least_score, least_share
        self.place = None

    def __getstate__(self):
        return self.vocabulary, self.weights, self.labels, self.least_score, self.least_share

    def __setstate__(self, state):
        self.__init__(*state)

    def places(self) -> np.ndarray:
        if self.place is None:
            small = len(self.vocabulary) < 1 << 15
            self.place = np.full(BASE[-1], -1, np.int16 if small else np.int32)
            self.place[self.vocabulary] = np.arange(len(self.vocabulary))
        return self.place

    def presence(self, column: pa.Array) -> np.ndarray:
        """1 where a text has a vocabulary n-gram."""
        self.places()
        out = np.zeros((len(column), len(self.vocabulary)), np.uint8)
        for value, owner in grams(column):
            v = self.place[value]
            known = v >= 0
            out[owner[known], v[known]] = 1
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        here = self.presence(column).astype(np.float32)
        size = np.sqrt(np.maximum(here.sum(axis=1, keepdims=True), 1))
        return (here @ self.weights) / size

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        lettered = np.array([has_letter(t) for t in column.to_pylist()], bool)
        if not self.labels:
            return [NONE] * len(column), np.zeros(len(column))
        value = self.score(column)
        best = value.argmax(axis=1)
        names = [self.labels[k] if ok else NONE for k, ok in zip(best, lettered)]
        score = np.clip((value.max(axis=1).astype(np.float64) + 1) / 2, 0, 1)
        return names, np.where(lettered, score, 0.0)

    def covered(self, column: pa.Array) -> np.ndarray:
        """Whether landmarks have as many of a text's n-grams of 3 as a known language asks for."""
        place = self.places()
        total, held = np.zeros(len(column)), np.zeros(len(column))
        for value, owner in grams(column):
            counts = (value >= BASE[2]) & (value != BLANK)
            total += np.bincount(owner[counts], minlength=len(column))
            held += np.bincount(owner[counts & (place[value] >= 0)], minlength=len(column))
        share = self.least_share
        least = total * share - SLACK * np.sqrt(total * share * (1 - share)) - TOKEN
        return (total == 0) | (held > 0) & (held >= least)


BLOCK = 256
"""Rows whose presence vectors are held as floating point at a time."""


class Presence:
    """0 and 1 per row and n-gram of the vocabulary; products go block by block."""

    def __init__(self, found: list[np.ndarray], vocabulary: np.ndarray):
        self.held = np.zeros((len(found), len(vocabulary)), np.uint8)
        for k, values in enumerate(found):
            at = np.searchsorted(vocabulary, values)
            at[at == len(vocabulary)] = 0
            self.held[k, at[vocabulary[at] == values]] = 1

    def unit(self, rows: np.ndarray | slice) -> np.ndarray:
        """Rows as vectors of length 1."""
        part = self.held[rows].astype(np.float32)
        return part / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Unit rows times a matrix."""
        parts = [self.unit(slice(k, k + BLOCK)) @ matrix for k in range(0, len(self.held), BLOCK)]
        return np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, matrix.shape[1]))


def sampled(docs: DataFrame, text: str, lang: str, per_language: int) -> DataFrame:
    """(_lang, _rank, _text): of each label the per_language rows of lowest hash, outside
    fold 0 and with a letter. Rows equal in label, id and text are one, so there are never
    more, however often rows repeat."""
    spark = docs.sparkSession
    usable = docs.where(docs[lang].isNotNull() & (fold_of(docs["doc_id"]) != 0) & docs[text].rlike(r"\p{L}")).select(
        docs[lang].alias("_lang"), docs["doc_id"].alias("_id"), F.xxhash64(docs[text]).alias("_t"),
        F.xxhash64(docs["doc_id"], docs[text]).alias("_h"))
    # Of a label with many rows, only hashes low enough for about four times as many as wanted are ranked.
    counts = usable.groupBy("_lang").agg(F.approx_count_distinct("_h", 0.02).alias("n")).collect()
    low = [(r["_lang"], min((1 << 63) - 1, (1 << 66) * per_language // max(r["n"], 1) - (1 << 63))) for r in counts]
    low = F.broadcast(spark.createDataFrame(low, "_lang1 string, _low long"))  # a row per label
    order = Window.partitionBy("_lang").orderBy("_h", "_id", "_t")
    chosen = (usable.join(low, (F.col("_lang") == F.col("_lang1")) & (F.col("_h") <= F.col("_low"))).select("_lang", "_id", "_t", "_h")
              .distinct().withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_language))
    rows = docs.select("doc_id", docs[lang].alias("_lang2"), F.xxhash64(docs[text]).alias("_t2"), docs[text].alias("_text")).join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("_lang2") == F.col("_lang")) & (F.col("_t2") == F.col("_t")))
    return rows.select("_lang", "_rank", "_text").dropDuplicates(["_lang", "_rank"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE,
        landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Trains on documents outside fold 0. What comes to the driver are the n-grams of
    the sampled rows, of which there are at most per_language a label."""
    source = sampled(docs, text, lang, per_language)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "_text", RUN_BYTES):
                each = [np.unique(np.concatenate([v for v, _ in grams(part.column(2).slice(k, 1))]), return_counts=True)
                        for k in range(part.num_rows)]
                sizes = np.array([len(x) for x, _ in each])
                flat, often = (np.concatenate([x[k] for x in each] or [np.zeros(0, np.int64)]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), lists(flat, sizes, pa.int32()), lists(often, sizes, pa.int32())],
                    names=["_lang", "_rank", "grams", "often"])

    held = source.mapInArrow(work, "_lang string, _rank int, grams array<int>, often array<int>").toArrow().sort_by(
        [("_lang", "ascending"), ("_rank", "ascending")])
    return trained([(lang_, rank, np.array(g.values, np.int64), np.array(o.values, np.int64)) for lang_, rank, g, o in zip(
        held.column("_lang").to_pylist(), held.column("_rank").to_pylist(), held.column("grams"), held.column("often"))], landmarks, ridge)


def trained(rows: list[tuple[str, int, np.ndarray, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of rows (label, rank, n-grams, how often each), by label and rank."""
    langs = [r[0] for r in rows]
    labels = sorted(set(langs))
    if not labels:
        return Model(np.zeros(0, np.int64), np.zeros((0, 0), np.float32), [])
    found = [r[2] for r in rows]
    marks = np.flatnonzero([r[1] <= landmarks for r in rows])
    vocabulary = np.unique(np.concatenate([found[k] for k in marks]))
    presence = Presence(found, vocabulary)
    kernel = presence.times(presence.unit(marks).T)  # of every row with every landmark
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    target = np.where(np.array(langs)[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    weight = np.linalg.solve(phi.T @ phi + ridge * len(found) * np.eye(phi.shape[1]), phi.T @ target)
    model = Model(vocabulary, (presence.unit(marks).T @ (root @ weight)).astype(np.float32), labels)
    value = presence.times(model.weights)
    right = value.argmax(axis=1) == np.array([labels.index(x) for x in langs])
    holders, own = presence.held[marks].sum(axis=0, dtype=np.int64), np.zeros(len(found), np.int64)
    own[marks] = 1
    share = np.ones(len(found))
    for k, (_, _, values, often) in enumerate(rows):
        counts = (values >= BASE[2]) & (values != BLANK)
        values, often = values[counts], often[counts]
        at = np.searchsorted(vocabulary, values)
        at[at == len(vocabulary)] = 0
        by_others = (vocabulary[at] == values) & (holders[at] > own[k])
        share[k] = often[by_others].sum() / max(often.sum(), 1)
    if right.any():
        score = (value.max(axis=1)[right] + 1) / 2
        model.least_score = float(max(np.quantile(score, LOW_QUANTILE) - SCORE_MARGIN, 0))
        model.least_share = float(max(np.quantile(share[right], LOW_QUANTILE) - SHARE_MARGIN, 0))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, `lang_pred` and `score`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of the landmarks
    source = docs.select(*[docs[c] for c in keep or ["doc_id"]], docs[text].alias("_text"))
    names = source.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "_text", RUN_BYTES):
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    lang, score = sent.value.predict(some.column(len(names)))
                    yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(lang, pa.string()), pa.array(score)],
                                                     names=[*names, "lang_pred", "score"])
    return source.mapInArrow(work, f"{schema}, lang_pred string, score double")


def known(docs: DataFrame, model: Model, least: float | None = None, text: str = "text") -> DataFrame:
    """The rows of docs whose text has letters and is in one of the model's languages; with
    `least`, the rows with letters and a language scored that or more, by the score alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, text, RUN_BYTES):
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    column = some.column(some.schema.get_field_index(text))
                    lang, score = sent.value.predict(column)
                    enough = score >= (sent.value.least_score if least is None else least)
                    if least is None and sent.value.labels:
                        enough &= sent.value.covered(column)
                    yield some.filter(pa.array([a != NONE and bool(b) for a, b in zip(lang, enough)], pa.bool_()))
    return docs.mapInArrow(work, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    return predict(docs, fit(docs)).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
