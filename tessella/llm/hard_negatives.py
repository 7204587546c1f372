"""Hard negatives by slot-decomposed selection.

An anchor's positives are its nearest rows of the same label. A negative of a positive
is a row of another label whose score lies in a window below the positive's score: from
`low` to `high` percent of it. The windows of one anchor overlap, so they are not
searched one by one. Their upper limits, in descending order, cut the scores into
disjoint slots; a row falls into one slot at most, and every slot keeps its first k rows
only, inside each shard and again where the shards meet. The first k rows below an upper
limit are then the first k of its slot and all slots after it, so one descending pass
over at most positives × k rows answers all windows of an anchor; their lower limits cut
off the end.

Both passes, for positives and for slots, send the anchors through the shards (see
shards): no pair of an anchor and a row leaves a task unless it is among the first k
there.

Defined cases: rows whose id, label or vector is NULL, or whose vector holds a NULL or
non-finite component, take no part; vectors of different length have no score; rows
with the anchor's id are its own; rows equal in id, label and vector count once, as
anchors too; an anchor without positives or a window without rows gives no rows; an
empty table gives an empty result; further columns are ignored. Scores beyond 64 bits
are held within them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import shards as S
from tessella.session import cut

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
ANCHOR_EVERY = 50


class Labelled:
    """The rows of a shard, by length of their vectors and then by id."""

    def __init__(self, table: pa.Table):
        self.parts = {}
        for size, rows, x in S.by_length(table):
            ids, label = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            order = np.lexsort((*x.T[::-1], label, ids)) if size else np.lexsort((label, ids))
            ids, label, x = ids[order], label[order], x[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (label[1:] != label[:-1]) | (x[1:] != x[:-1]).any(axis=1)
            self.parts[size] = ids[new], label[new], x[new]

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, ids of the rows, scores with NONE at rows of the anchor's id, which
        rows are of the anchor's label)."""
        for size, some, q in S.by_length(batch):
            if size not in self.parts:
                continue
            ids, label, x = self.parts[size]
            scores = S.dots(q, x)
            scores[some.column("vec_id").to_numpy()[:, None] == ids[None, :]] = S.NONE
            yield some, ids, scores, some.column("label").to_numpy()[:, None] == label[None, :]


def percent(score: Column, share: int) -> Column:
    return score.cast("decimal(20,0)") * F.lit(share).cast("decimal(4,0)") * F.expr("0.01BD")


def nearest_of_label(rows: DataFrame, anchors: DataFrame, shards: int, k: int) -> DataFrame:
    """(anchor, positive_id, positive_score, place): the first k rows of the anchor's label."""
    def answer(made: Labelled, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some, ids, scores, same in made.scored(batch):
            scores[~same] = S.NONE
            row, column = S.first(scores, k)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [some.column("anchor").take(pa.array(row)), pa.array(ids[column]), pa.array(scores[row, column])],
                    names=["anchor", "positive_id", "positive_score"])
    found = S.visit(rows, anchors, shards, Labelled, answer, "anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def fill_slots(rows: DataFrame, anchors: DataFrame, shards: int, k: int) -> DataFrame:
    """(anchor, slot, negative_id, negative_score): the first k rows of other labels in
    every slot. anchors have `limits`, descending, and `least`, the lowest lower limit."""
    def answer(made: Labelled, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some, ids, scores, same in made.scored(batch):
            limits = some.column("limits")
            many = np.diff(limits.offsets.to_numpy())
            flat, starts = limits.flatten().to_numpy(), np.cumsum(many) - many
            scores[same | (scores < some.column("least").to_numpy()[:, None])] = S.NONE
            for slot in range(int(many.max(initial=0))):
                has, more = np.flatnonzero(many > slot), many > slot + 1
                below = scores[has]
                below[below > flat[starts[has] + slot][:, None]] = S.NONE
                under = np.where(more[has], flat[np.minimum(starts[has] + slot + 1, len(flat) - 1)], S.NONE)
                below[below <= under[:, None]] = S.NONE
                row, column = S.first(below, k)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [some.column("anchor").take(pa.array(has[row])), pa.array(np.full(len(row), slot, np.int32)),
                         pa.array(ids[column]), pa.array(below[row, column])],
                        names=["anchor", "slot", "negative_id", "negative_score"])
    found = S.visit(rows, anchors, shards, Labelled, answer,
                    "anchor long, slot int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def mine(vectors: DataFrame, is_anchor: Column, vector: str = "embedding", label: str | Column = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         shard_values: int = S.SHARD_VALUES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    is_anchor: a condition on the columns of vectors; label: a column of whole numbers."""
    label = vectors[label] if isinstance(label, str) else label
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          vectors[vector].alias("vector"), is_anchor.alias("is_anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & S.sound(F.col("vector")))
    shards = max(1, S.count_shards(rows, shard_values))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    anchors = (rows.where("is_anchor").select(F.xxhash64("vec_id", "label", "vector").alias("anchor"),
                                              "vec_id", "label", "vector").dropDuplicates(["anchor"]))
    rows = rows.drop("is_anchor")
    near = nearest_of_label(rows, anchors.select("*", everywhere), shards, positives)
    near = cut(near.withColumns({"upper": F.floor(percent(F.col("positive_score"), high)).cast("long"),
                                 "lower": F.ceil(percent(F.col("positive_score"), low)).cast("long")})
               .where("lower <= upper"))
    windows = near.groupBy(F.col("anchor").alias("_anchor")).agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("least"))
    anchors = anchors.join(windows, F.col("anchor") == F.col("_anchor")).drop("_anchor")
    kept = fill_slots(rows, anchors.select("*", everywhere), shards, negatives)
    slots = kept.groupBy(F.col("anchor").alias("_anchor")).agg(F.sort_array(F.collect_list(F.struct(
        "slot", (-F.col("negative_score")).alias("less"), "negative_id"))).alias("slots"))
    names = anchors.select(F.col("anchor").alias("_own"), F.col("vec_id").alias("anchor_id"), "limits")
    answered = (near.join(slots, F.col("anchor") == F.col("_anchor")).join(names, F.col("anchor") == F.col("_own"))
                .withColumn("_slot", F.array_position("limits", F.col("upper")) - 1)
                .withColumn("_some", F.slice(F.filter("slots", lambda x: x.slot >= F.col("_slot")), 1, negatives)))
    inside = F.filter("_some", lambda x: -x.less >= F.col("lower"))
    return (answered.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("_at", "_n"))
            .select("anchor_id", "positive_id", (F.col("_at") + 1).cast("int").alias("rank"),
                    F.col("_n.negative_id").alias("negative_id"), "positive_score",
                    (-F.col("_n.less")).alias("negative_score")))


def report(vectors: DataFrame) -> DataFrame:
    """Negatives of every anchor, labels of ids divisible by 7 moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % ANCHOR_EVERY == 0, label=moved)


ORACLE = """
WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""
