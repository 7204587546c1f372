"""Reachability over links, taken as undirected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest id of each group of mutually reachable
    notes, by alternating large-star and small-star steps (Kiveris et al.,
    2014), O(log n) rounds. A step is a min per node, combined map-side, and a
    join whose small side has one row per node; each round is checkpointed."""
    edges = cut(links.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(linked.unionByName(low.select("u", F.col("m").alias("v")))
                    .where("u <> v").distinct())
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    label = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.col("note_id").alias("node")).join(
        label, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def reachable(nodes: DataFrame, links: DataFrame, start: str, max_hops: int = 12) -> DataFrame:
    """Notes connected to the start: a frontier walk for nearby groups, the
    component table when the group is deeper than that."""
    both = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    seen = nodes.where(F.col("note_id") == start).select(F.col("note_id").alias("node"))
    frontier = seen
    for _ in range(max_hops):
        found = (both.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi")
                 .select(F.col("dst").alias("node")).distinct())
        frontier = cut(found.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    groups = components(nodes, links)
    mine = groups.where(F.col("node") == start).select("component")
    return groups.join(mine, "component", "left_semi").select("node")


def newest_group(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """What exporting everything emits: the group of the newest note."""
    groups = components(nodes, links)
    newest = nodes.orderBy(F.desc("updated_at"), F.asc("note_id")).limit(1)
    mine = groups.join(newest.select(F.col("note_id").alias("node")), "node", "left_semi")
    return groups.join(mine.select("component"), "component", "left_semi").select("node")
