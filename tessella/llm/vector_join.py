"""Exact cosine join of vectors with equal labels, by a subspace pigeonhole.

Unit vectors with cosine c have squared distance 2 - 2c. After a fixed random
rotation the dimensions are split into blocks of four, and the squared distance
allowed is split over the blocks in proportion to their dimensions: in at least one
block a linked pair keeps within the block's budget, so each block is range-joined on
its own and what any block finds is verified exactly, on the vectors as given.

A block is cut into cells four radii wide; a vector goes to every cell within half a
radius, so a pair within the radius meets in the cell of its midpoint. A pair is
counted once: by the first block that has it within budget, in that cell. Tasks
return sums of links per vector and edges that span what they found linked, not
pairs. Equal vectors of a label are one node with a multiplicity. A cell with more
than `TILE_ROWS` rows is split into chunks, and each two chunks meet in a task of
their own.

Defined cases: vectors that are NULL, empty, zero or hold a NULL or non-finite
component, and those with a NULL label, link with nothing and are their own
component; vectors of different length never link; rows with equal ids are separate
vectors; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import spanning
from tessella.llm.hashing import mix
from tessella.operators.graph import components
from tessella.session import cut

COSINE = 0.98
BLOCK = 4
CELL = 4.0
"""Width of a cell in radii."""
SLACK = 1e-9
TILE_ROWS = 20_000
TILE = 512
SEED = 11
U = np.uint64


class Space:
    """Rotation, blocks and budgets for vectors of one length."""

    def __init__(self, size: int, cosine: float):
        q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
        self.rotation = q * np.sign(np.diag(r))
        self.cosine = cosine
        self.blocks = np.array_split(np.arange(size), math.ceil(size / BLOCK))
        self.starts = np.array([b[0] for b in self.blocks])
        self.budget = np.array([(2 - 2 * cosine) * len(b) / size for b in self.blocks]) + SLACK
        self.radius = np.sqrt(self.budget) * (1 + 1e-6)

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return unit(x) @ self.rotation

    def cells(self, r: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, cell of each) for all cells a vector goes to."""
        width, half = CELL * self.radius[block], self.radius[block] / 2
        part = r[:, self.blocks[block]]
        low, high = (np.floor((part + d) / width).astype(np.int64) for d in (-half, half))
        for side in itertools.product((False, True), repeat=part.shape[1]):
            side = np.array(side)
            rows = np.flatnonzero((~side | (low != high)).all(axis=1))
            yield rows, np.where(side, high, low)[rows]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cell_key(base: np.ndarray, block: int | np.ndarray, cell: np.ndarray) -> np.ndarray:
    key = mix(base.view(U) + np.asarray(block, U) * U(0x9E3779B97F4A7C15))
    for k in range(cell.shape[1]):
        key = mix(key ^ cell[:, k].astype(np.int64).view(U))
    return key.view(np.int64)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column without NULLs."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def spread(nodes: DataFrame, cosine: float, vectors: bool = True) -> DataFrame:
    """A row per node, block and cell: (key, block, base, node, copies, vector), or the
    keys alone."""
    kind = nodes.schema["vector"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, Space] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("vector"))
            length, _ = _matrix(column)
            for size in np.unique(length):
                some = batch.filter(pa.array(length == size))
                space = spaces.setdefault(int(size), Space(int(size), cosine))
                column = some.column(some.schema.get_field_index("vector"))
                r = space.rotated(_matrix(column)[1].reshape(-1, size))
                base = some.column(some.schema.get_field_index("base")).to_numpy() + size
                for b in range(len(space.blocks)):
                    for rows, cell in space.cells(r, b):
                        if not len(rows):
                            continue
                        key = pa.array(cell_key(base[rows], b, cell))
                        if not vectors:
                            yield pa.RecordBatch.from_arrays([key], names=["key"])
                            continue
                        taken = some.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [key, pa.array(np.full(len(rows), b, np.int32)), pa.array(base[rows]),
                             taken.column("node"), taken.column("copies"), taken.column("vector")],
                            names=["key", "block", "base", "node", "copies", "vector"])
    source = nodes.select("node", "copies", "base", "vector")
    return source.mapInArrow(work, f"key long, block int, base long, node long, copies long, vector {kind}"
                             if vectors else "key long")


def tiles(rows: DataFrame, keys: DataFrame, limit: int = TILE_ROWS) -> DataFrame:
    """Adds `tile` (a pair of chunks) and `chunk`; rows of cells above the limit are
    repeated once per chunk."""
    hot = cut(keys.groupBy("key").count().where(F.col("count") > limit)
              .select(F.col("key").alias("_hot"), F.ceil(F.col("count") / limit).cast("int").alias("_n")))
    if hot.isEmpty():
        return rows.withColumns({"tile": F.lit(0).cast("long"), "chunk": F.lit(0)})
    n = F.coalesce("_n", F.lit(1))
    rows = rows.join(hot, F.col("key") == F.col("_hot"), "left").withColumn("chunk", F.pmod(F.hash("node"), n))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("tile", (F.least("chunk", "_other") * n + F.greatest("chunk", "_other")).cast("long")).drop(
        "_hot", "_n", "_other")


class Found:
    """Links of one group of rows that share a cell."""

    def __init__(self, space: Space, key: int, base: int, block: int, chunk: np.ndarray, x: np.ndarray):
        self.space, self.key, self.base, self.block, self.chunk = space, key, base, block, chunk
        self.x, self.r = unit(x), space.rotated(x)

    def candidates(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within this block's budget that no earlier block surely has."""
        keep = None
        for k in range(self.block, -1, -1):
            dims = self.space.blocks[k]
            p, q = self.r[a][:, dims], self.r[b][:, dims]
            square = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (p @ q.T)
            if keep is None:
                keep = square <= self.space.budget[k] + 1e-7
                if a == b:
                    keep &= np.tri(*keep.shape, -1, dtype=bool).T
            else:
                keep &= square > self.space.budget[k] - 1e-7
            if not keep.any():
                break
        i, j = np.nonzero(keep)
        return i + a.start, j + b.start

    def own(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are linked and counted here: exact, and the same for a pair anywhere."""
        square = (self.r[i] - self.r[j]) ** 2
        within = np.add.reduceat(square, self.space.starts, axis=1) <= self.space.budget
        mine = within[:, self.block] & ~within[:, :self.block].any(axis=1)
        dims = self.space.blocks[self.block]
        middle = (self.r[i][:, dims] + self.r[j][:, dims]) / 2
        cell = np.floor(middle / (CELL * self.space.radius[self.block])).astype(np.int64)
        mine &= cell_key(np.full(len(i), self.base), self.block, cell) == self.key
        return mine & ((self.x[i] * self.x[j]).sum(axis=1) >= self.space.cosine)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        out = []
        several = len(np.unique(self.chunk)) > 1
        for a0 in range(0, n, TILE):
            for b0 in range(a0, n, TILE):
                i, j = self.candidates(slice(a0, min(n, a0 + TILE)), slice(b0, min(n, b0 + TILE)))
                if several:
                    across = self.chunk[i] != self.chunk[j]
                    i, j = i[across], j[across]
                for k in range(0, len(i), 1 << 14):
                    part = slice(k, k + (1 << 14))
                    mine = self.own(i[part], j[part])
                    out.append((i[part][mine], j[part][mine]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none
        return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])


def compare(rows: DataFrame, cosine: float) -> DataFrame:
    """(node, other, links): links counted for a node, or an edge to another node."""
    def finish(held: list[pa.RecordBatch], spaces: dict[int, Space]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        if not table.num_rows:
            return
        key, tile, block, base, node, copies, chunk = (table.column(c).to_numpy() for c in (
            "key", "tile", "block", "base", "node", "copies", "chunk"))
        length, flat = _matrix(table.column("vector").chunk(0))
        ends = np.cumsum(length)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate((first, [len(key)])))
        out = []
        for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
            d = int(length[a])
            x = flat[ends[a] - d:ends[a + n - 1]].reshape(n, d)
            space = spaces.setdefault(d, Space(d, cosine))
            i, j = Found(space, key[a], base[a], int(block[a]), chunk[a:a + n], x).links()
            if not len(i):
                continue
            here, many = node[a:a + n], copies[a:a + n]
            count = (np.bincount(i, weights=many[j], minlength=n) + np.bincount(j, weights=many[i], minlength=n)).astype(np.int64)
            low = spanning(n, i, j)
            some = np.flatnonzero(count)
            edge = np.flatnonzero(low != np.arange(n))
            out.append((here[some], here[some], count[some]))
            out.append((here[edge], here[low[edge]], np.zeros(len(edge), np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                             names=["node", "other", "links"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, Space] = {}
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile = batch.column("key").to_numpy(), batch.column("tile").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (tile != tile[-1]))
            at = int(last[-1]) + 1 if len(last) else 0  # where the last, open group starts
            if at or (held and (held[-1].column("key")[-1].as_py(), held[-1].column("tile")[-1].as_py()) != (key[0], tile[0])):
                yield from finish([*held, batch.slice(0, at)], spaces)
                held = []
            held.append(batch.slice(at))
        if held:
            yield from finish(held, spaces)

    return (rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "node")
            .mapInArrow(work, "node long, other long, links long"))


def join(vectors: DataFrame, vector: str = "embedding", label: str = "label", cosine: float = COSINE,
         tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors."""
    e = F.col("_e")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = F.col("_l").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, bad) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", vectors[label].alias("_l"), vectors[vector].alias("_e")).withColumn(
        "node", F.when(good, F.xxhash64("_l", "_e")))
    nodes = cut(rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("id"), F.xxhash64(F.first("_l")).alias("base"),
        F.first("_e").alias("vector")))
    found = cut(compare(tiles(spread(nodes, cosine), spread(nodes, cosine, vectors=False), tile_rows), cosine))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = cut(found.where("node <> other").select(F.col("node").alias("src"), F.col("other").alias("dst")).distinct())
    ends = edges.select(F.explode(F.array("src", "dst")).alias("note_id")).distinct()
    comps = cut(components(ends, edges)).withColumnsRenamed({"node": "_node", "component": "_c"})
    small = nodes.select("node", "copies", "id").join(comps, F.col("node") == F.col("_node"), "left").join(
        links.withColumnsRenamed({"node": "_n", "links": "_links"}), F.col("node") == F.col("_n"), "left").select(
        F.col("node").alias("_node"), "copies", "id", F.coalesce("_c", "node").alias("_c"),
        F.coalesce("_links", F.lit(0)).alias("_links"))
    least = small.groupBy(F.col("_c").alias("_comp")).agg(F.min("id").alias("_least"))
    placed = small.join(least, F.col("_c") == F.col("_comp"))
    component = F.coalesce("_least", "vec_id")
    return (rows.select("vec_id", "node").join(placed, F.col("node") == F.col("_node"), "left")
            .select("vec_id", F.coalesce(F.col("_links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")))
