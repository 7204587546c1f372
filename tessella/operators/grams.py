"""Names of any number found in texts: hashed grams, a filter of bits, a join.

Every gram of a text that is as long as some name could be a name; written out, those
are the text many times over. So before a gram leaves its text it is looked up in two
filters of bits, made of the names: one of their first characters, which few places of
a text pass, and one of whole names, looked up at these places only. Hashes of all
stretches come from one line of running sums. What passes is joined with the names, so
a bit set by chance costs a row and no more.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import automaton as au
from tessella.functions.rows import unnest

U = np.uint64
STEP = 0xD1342543DE82EF95
HEAD = 3
"""Characters of a name in the first filter."""
LEAST_BITS, MOST_BITS = 12, 26
"""Sizes of a filter, as powers of two; it has 16 bits a name or more up to the largest."""


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(32))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(29))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        out = np.full(n, base, U)
        out[0] = 1
        return np.multiply.accumulate(out)
    return up(STEP), up(pow(STEP, -1, 1 << 64))


class Stretches:
    """Hashes of stretches of a line of code points."""

    def __init__(self, codes: np.ndarray):
        power, self.inverse = _powers(1 << max(10, int(len(codes)).bit_length()))
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum((codes.astype(U) + U(1)) * power[:len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: int | np.ndarray, salt: int | np.ndarray) -> np.ndarray:
        raw = (self.sums[start + size] - self.sums[start]) * self.inverse[start]
        return _mix(raw ^ (np.asarray(salt).astype(U) * U(0x9E3779B97F4A7C15)))


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Two bits of a filter for each hash."""
    yield (hashes >> U(64 - bits)).astype(np.int64)
    yield (hashes & U((1 << bits) - 1)).astype(np.int64)


class Filter:
    """Which stretches may be names. lengths: of names."""

    def __init__(self, lengths: list[int], bits: int, words: np.ndarray):
        self.lengths, self.bits, self.words = lengths, bits, words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in _places(hashes, self.bits):
            out &= (self.words[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool)
        return out

    def find(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of what passes; ends: of the text of each place."""
        hashed, starts, sizes = Stretches(codes), [], []
        heads: dict[int, np.ndarray] = {}
        for n in self.lengths:
            head = min(n, HEAD)
            if head not in heads:
                at = np.flatnonzero(ends - np.arange(len(codes)) >= head)
                heads[head] = at[self.has(hashed.of(at, head, head))]
            at = heads[head][ends[heads[head]] - heads[head] >= n]
            at = at[self.has(hashed.of(at, n, n + HEAD))]
            starts.append(at)
            sizes.append(np.full(len(at), n))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(sizes)


def make_filter(names: DataFrame, name: str) -> Filter:
    """The filter of all names, made where the names are; its words of 64 bits come to
    the driver, at most 2^20 of them."""
    counts = names.groupBy(F.length(name).alias("n")).count().collect()
    total = sum(r["count"] for r in counts)
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * total).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in au.runs(batch.column(0)):
                codes, begins = au.characters(run)
                size = np.diff(begins) - 1
                hashed, head = Stretches(codes), np.minimum(size, HEAD)
                found = [p for h in (hashed.of(begins[:-1], head, head), hashed.of(begins[:-1], size, size + HEAD))
                         for p in _places(h, bits)]
                at = np.unique(np.concatenate(found))
                word, first = np.unique(at >> 6, return_index=True)
                held = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), first) if len(at) else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(held.view(np.int64))], names=["at", "bits"])
    marked = names.select(name).mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(1 << (bits - 6), U)
    for r in marked.toLocalIterator():
        words[r["at"]] = np.int64(r["bits"]).view(U)
    return Filter(sorted(r["n"] for r in counts), bits, words)


def grams(docs: DataFrame, key: str, names: DataFrame, name: str, text: str = "text") -> DataFrame:
    """(key, start, gram): the stretches of the texts that pass the filter of the names."""
    known = make_filter(names, name)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("gram", pa.string())]))

    @F.arrow_udf("array<struct<start:int,gram:string>>")
    def passing(texts: pa.Array) -> pa.Array:
        out: list[pa.Array] = []
        for run in au.runs(texts):
            codes, begins = au.characters(run)
            start, size = known.find(codes, np.repeat(begins[1:] - 1, np.diff(begins)))
            of = np.searchsorted(begins, start, side="right") - 1
            held, found = run.to_pylist(), [[] for _ in range(len(run))]
            for t, s, n in zip(of.tolist(), (start - begins[of]).tolist(), size.tolist()):
                found[t].append({"start": s, "gram": held[t][s:s + n]})
            out.append(pa.array(found, kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)
    return unnest(docs, [key], passing(F.col(text)), "g").select(key, "g.*")


def gram_join(docs: DataFrame, key: str, names: DataFrame, name: str, text: str = "text") -> DataFrame:
    """(key, start, and the columns of names) for every place at which a name stands,
    overlapping ones too. NULL and empty names stand nowhere."""
    names = names.where(F.col(name) != "").distinct()
    found = grams(docs, key, names, name, text)
    return found.join(names, F.col("gram") == F.col(name)).select(key, "start", *names.columns)
