"""Shards of vectors that queries visit, and exact integer scores inside them.

Vectors are dealt by a hash of their id into shards of a bounded number of values,
whatever their label or likeness, so copies and hot labels spread evenly. A query
goes to the shards it is sent to and meets their rows in one task, which reads the
shard once and then answers its queries a few at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_VALUES = 1 << 19
"""Components of a shard's vectors, about."""
QUERIES = 256
"""Queries answered together."""
STEPS = 256.0
NONE = np.iinfo(np.int64).min
"""The score of a pair that does not count."""
LARGEST = (1 << 63) - 1024


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def count_shards(rows: DataFrame, shard_values: int = SHARD_VALUES) -> int:
    """How many shards hold rows (with `vector`), 0 for an empty table."""
    n, values = rows.agg(F.count("*"), F.sum(F.size("vector"))).first()
    return math.ceil(max(n, values) / shard_values) if n else 0


def own_shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")


def steps(column: pa.Array) -> np.ndarray:
    """floor(256 x) of every component, flat; beyond 64 bits the nearest number within."""
    x = np.floor(STEPS * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return np.clip(x, -LARGEST, LARGEST).astype(np.int64)


def by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, matrix) of the rows with vectors of that length."""
    column = batch.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    for size in np.unique(length):
        some = batch.filter(pa.array(length == size))
        part = some.column("vector")
        part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
        yield int(size), some, steps(part).reshape(some.num_rows, size)


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, exact in 64 bits: by floating point where every partial sum
    is a whole number below 2^53, else by Python's numbers, held within 64 bits."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    wide = q.astype(object) @ x.astype(object).T
    return np.clip(wide, -LARGEST, LARGEST).astype(np.int64)


def first(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first k scores of each row, the highest first and of equal
    ones the leftmost; NONE is never one."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k:n - k + 1] if n > k else np.full((len(scores), 1), NONE)
    row, column = np.nonzero((scores >= least) & (scores > NONE))
    return leading(row, -scores[row, column], column, k)


def leading(row: np.ndarray, key: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, tie) of the first k of each row by key, then tie."""
    order = np.lexsort((tie, key, row))
    row, tie = row[order], tie[order]
    begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(row)]))))
    return row[rank < k], tie[rank < k]


Build = Callable[[pa.Table], object]
Answer = Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]]


def visit(rows: DataFrame, queries: DataFrame, shards: int, build: Build, answer: Answer, schema: str) -> DataFrame:
    """Queries (shard and columns of their own) meet the rows of their shard: build gets
    a shard's rows, answer what it made of them and some of the shard's queries. Rows
    and queries both have vec_id and vector."""
    columns = ["shard", "kind", *dict.fromkeys([*rows.columns, *[c for c in queries.columns if c != "shard"]])]
    both = (rows.withColumns({"shard": own_shard(shards), "kind": F.lit(0)})
            .unionByName(queries.withColumn("kind", F.lit(1)), allowMissingColumns=True)).select(*columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, made = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            turn = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(place)]):
                if place[a] != shard:
                    shard, held, made = place[a], [], None
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if made is None and held:
                    made, held = build(pa.Table.from_batches(held)), []
                if made is not None:
                    for at in range(a, b, QUERIES):
                        yield from answer(made, batch.slice(at, min(QUERIES, b - at)))
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(work, schema)
