"""Exact search for the highest inner products by ball trees and branch and bound.

Every shard of the vectors (see shards) builds a ball tree: nodes hold a centre and a
radius, and no vector in a node scores above centre·query + radius·|query|. A query
opens the node of highest bound next, and stops when that bound is below its kth score
so far. The kth score is shared twice: among all nodes of a shard as the search goes, and
among shards in two rounds. A query first searches the shard of its own id; what it finds
there, its first k, sets the score below which no other shard opens a node.

Of more than k + 1 equal vectors in a shard only those of the k + 1 smallest ids can be
among anyone's first k, so the tree holds no more of them and large groups of copies cost
nothing.

Defined cases: rows whose id or vector is NULL, or whose vector holds a NULL or
non-finite component, take no part; vectors of different length have no score; rows with
the query's id are its own; rows equal in id and vector count once, as queries too; an
empty table gives an empty result; further columns are ignored. Equal scores go by the
smaller id. Scores beyond 64 bits are held within them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import shards as S
from tessella.session import cut

K = 5
QUERY_EVERY = 50
LEAF = 64
"""Vectors in a leaf, at most."""
SLACK = 1e-9
"""Relative rounding error granted to a bound."""


class BallTree:
    """Whole-numbered vectors of one length, with the ids that break ties."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        same = (x[1:] == x[:-1]).all(axis=1)
        new = np.concatenate(([True], ~(same & (ids[1:] == ids[:-1]))))
        ids, x = ids[new], x[new]
        head = np.flatnonzero(np.concatenate(([True], ~(x[1:] == x[:-1]).all(axis=1))))
        copy = np.arange(len(ids)) - np.repeat(head, np.diff(np.concatenate((head, [len(ids)]))))
        ids, x = ids[copy <= k], x[copy <= k]
        self.k, self.nodes = k, []
        real, order = x.astype(np.float64), np.arange(len(ids))
        waiting = [(0, len(ids), None)]
        child: dict[int, int] = {}
        for a, b, parent in waiting:  # breadth first: the two children of a node are neighbours
            node, part = len(self.nodes), real[order[a:b]]
            if parent is not None:
                child.setdefault(parent, node)
            centre = part.mean(axis=0)
            self.nodes.append((centre, np.sqrt(((part - centre) ** 2).sum(axis=1).max()), a, b))
            if b - a > LEAF:
                wide = int(np.ptp(part, axis=0).argmax()) if part.shape[1] else 0
                half = (b - a) // 2
                if part.shape[1]:
                    order[a:b] = order[a:b][np.argpartition(part[:, wide], half)]
                waiting += [(a, a + half, node), (a + half, b, node)]
        self.ids, self.x = ids[order], x[order]
        self.centre = np.array([n[0] for n in self.nodes])
        self.radius = np.array([n[1] for n in self.nodes])
        self.long = np.sqrt((self.centre ** 2).sum(axis=1)) + self.radius
        self.child = np.array([child.get(i, -1) for i in range(len(self.nodes))])

    def bound(self, q: np.ndarray, norm: np.ndarray, node: np.ndarray) -> np.ndarray:
        """No vector in the node scores above this."""
        return (q * self.centre[node]).sum(axis=1) + norm * (self.radius[node] + SLACK * self.long[node]) + SLACK

    def search(self, own: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's first k that score no less than `least`."""
        m, real = len(q), q.astype(np.float64)
        norm = np.sqrt((real * real).sum(axis=1))
        waiting = np.full((m, len(self.nodes)), -np.inf)
        waiting[:, 0] = self.bound(real, norm, np.zeros(m, np.int64))
        kth = least.copy()
        row, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        active = np.arange(m)
        while len(active):
            best = waiting[active].argmax(axis=1)
            top = waiting[active, best]
            level = kth[active].astype(np.float64)
            open_ = (top > -np.inf) & (top >= level - SLACK * np.abs(level))
            active, best = active[open_], best[open_]
            waiting[active, best] = -np.inf
            inner = self.child[best] >= 0
            for side in (0, 1):
                who, node = active[inner], self.child[best[inner]] + side
                waiting[who, node] = self.bound(real[who], norm[who], node)
            found = [self.leaf(node, active[~inner][best[~inner] == node], q, own, kth) for node in np.unique(best[~inner])]
            if any(len(f[0]) for f in found):
                row, ids, scores = (np.concatenate((a, *b)) for a, b in zip((row, ids, scores), zip(*found)))
                row, ids, scores = self.best(row, ids, scores)
                full = np.flatnonzero(np.bincount(row, minlength=m) == self.k)
                if len(full):
                    last = np.searchsorted(row, full, side="right") - 1
                    kth[full] = np.maximum(kth[full], scores[last])
        return row, ids, scores

    def leaf(self, node: int, who: np.ndarray, q: np.ndarray, own: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, id, score) in a leaf that may be among the first k."""
        _, _, a, b = self.nodes[node]
        scores = S.dots(q[who], self.x[a:b])
        i, j = np.nonzero((scores >= kth[who][:, None]) & (own[who][:, None] != self.ids[a:b][None, :]))
        return who[i], self.ids[a:b][j], scores[i, j]

    def best(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        rank = np.arange(len(row)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(row)]))))
        return row[rank < self.k], ids[rank < self.k], scores[rank < self.k]


def searched(rows: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """(query, vec_id, score): the first k of each query in each shard it is sent to, as far
    as they score no less than its `least`."""
    def build(table: pa.Table) -> dict[int, BallTree]:
        return {size: BallTree(some.column("vec_id").to_numpy(), x, k) for size, some, x in S.by_length(table)}

    def answer(trees: dict[int, BallTree], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for size, some, q in S.by_length(batch):
            if size in trees:
                row, ids, scores = trees[size].search(some.column("vec_id").to_numpy(), q, some.column("least").to_numpy())
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [some.column("query").take(pa.array(row)), pa.array(ids), pa.array(scores)],
                        names=["query", "vec_id", "score"])
    return S.visit(rows, queries, shards, build, answer, "query long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, vector: str = "embedding", k: int = K,
           shard_values: int = S.SHARD_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: a condition on the columns of vectors."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors[vector].alias("vector"),
                          is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & S.sound(F.col("vector")))
    shards = max(1, S.count_shards(rows, shard_values))
    queries = rows.where("is_query").select(F.xxhash64("vec_id", "vector").alias("query"), "vec_id", "vector").dropDuplicates(["query"])
    rows = rows.drop("is_query")
    home = queries.withColumns({"shard": S.own_shard(shards), "least": F.lit(int(S.NONE) + 1).cast("long")})
    found = cut(searched(rows, home, shards, k))
    if shards > 1:
        kth = found.groupBy(F.col("query").alias("_query")).agg(F.count("*").alias("_n"), F.min("score").alias("_kth"))
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != S.own_shard(shards))
        away = (queries.join(kth, F.col("query") == F.col("_query"), "left")
                .withColumn("least", F.when(F.col("_n") >= k, F.col("_kth")).otherwise(F.lit(int(S.NONE) + 1)))
                .select("query", "vec_id", "vector", "least", F.explode(others).alias("shard")))
        found = found.unionByName(searched(rows, away, shards, k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    names = queries.select(F.col("query").alias("_query"), F.col("vec_id").alias("query_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(names, F.col("query") == F.col("_query")).select("query_id", "rank", "vec_id", "score"))


def report(vectors: DataFrame) -> DataFrame:
    """The highest scores of every 50th id."""
    return search(vectors, F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = """
WITH rows AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, r.v) DESC, r.vec_id) AS rank
  FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
