"""A Merkle manifest of a dataset in van Emde Boas layout.

Every row is a leaf, and the leaves of a source, in order of their ids, form a tree of
runs of 16. The tree is cut into blocks: aligned subtrees of `HEIGHT` levels of runs. A
block is stored as one array of digests in van Emde Boas order: its levels are split at
half height, the upper half is stored first and after it each lower subtree, all by the
same rule. So the nodes of a run lie together, and a path from a leaf to the block's root
touches few stretches of memory whatever size a stretch has. Where a node stands is
arithmetic on its depth and place; building a block and reading siblings both go by it.

Blocks are built side by side, however large their source is. Their roots are the leaves
of the next round of blocks, until each source has one node, and the nodes of all sources,
in order of the sources, are the leaves of a last tree of the same kind. `manifest` holds
these blocks, a row each. Proofs go the other way: each block hands the siblings above it
to the blocks below, again side by side.

Places: rows are sorted by range partitions, numbered inside each, and shifted by the
numbers of rows in the partitions before.

Defined cases: rows of equal id and content are leaves each and are interchangeable; a
NULL id comes before all others and is never tampered with; a NULL source is a source and
comes first; NULL columns are hashed as `-`; an empty table has no blocks and gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut

FAN = 16
HEIGHT = 3
"""Levels of runs in a block: 4,096 leaves and 4,369 nodes."""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
TAMPER = 5
Steps = list[tuple[bytes, bytes]]
"""Siblings to the left and to the right, in hex, level by level."""


# ------------------------------------------------------------------ layout

def size(levels: int) -> int:
    """Nodes of a whole tree of so many levels of nodes."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, place: np.ndarray) -> np.ndarray:
    """Where the nodes at a depth (the root: 0) stand in the array of a tree."""
    if levels == 1:
        return np.zeros_like(place)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, place)
    below = FAN ** (depth - upper)
    lower = levels - upper
    return size(upper) + place // below * size(lower) + address(lower, depth - upper, place % below)


@functools.lru_cache(maxsize=64)
def places(levels: int, depth: int) -> np.ndarray:
    """The address of every node at a depth."""
    return address(levels, depth, np.arange(FAN ** depth))


def rounds(n: int) -> int:
    """Levels of runs above n leaves."""
    k = 0
    while FAN ** k < n:
        k += 1
    return k


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def plant(leaves: np.ndarray, runs: int) -> np.ndarray:
    """The array of a block: leaves (n × 32 bytes) and `runs` levels above them; a last
    run may be short, nodes that no leaf is below stay empty."""
    nodes = np.zeros((size(runs + 1), DIGEST), np.uint8)
    nodes[places(runs + 1, runs)[:len(leaves)]] = leaves
    n = len(leaves)
    for depth in range(runs - 1, -1, -1):
        children = nodes[places(runs + 1, depth + 1)[:n]].tobytes()
        n = -(-n // FAN)
        step = FAN * DIGEST
        made = b"".join(digest(children[k * step:(k + 1) * step].hex().encode()) for k in range(n))
        nodes[places(runs + 1, depth)[:n]] = np.frombuffer(made, np.uint8).reshape(n, DIGEST)
    return nodes


def run_of(nodes: np.ndarray, runs: int, depth: int, place: int, n: int) -> bytes:
    """The digests of a run, in hex: the node at (depth, place) and its siblings, of n
    nodes at that depth."""
    first = place // FAN * FAN
    at = places(runs + 1, depth)[first:min(n, first + FAN)]
    return nodes[at].tobytes().hex().encode()


def path(nodes: np.ndarray, runs: int, place: int, n: int) -> Steps:
    """(siblings to the left, to the right), in hex, level by level up to the block's root."""
    out = []
    for depth in range(runs, 0, -1):
        run, k = run_of(nodes, runs, depth, place, n), place % FAN * 2 * DIGEST
        out.append((run[:k], run[k + 2 * DIGEST:]))
        place, n = place // FAN, -(-n // FAN)
    return out


def fold(node: bytes, steps: Steps) -> bytes:
    """The root that a node (in hex) and its siblings give."""
    for left, right in steps:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def packed(steps: Steps) -> tuple[bytes, list[int]]:
    return b"".join(left + right for left, right in steps), [x for left, right in steps for x in (len(left), len(right))]


def unpacked(data: bytes, lengths: list[int]) -> Steps:
    ends = np.cumsum(lengths).tolist()
    parts = [data[b - n:b] for b, n in zip(ends, lengths)]
    return list(zip(parts[::2], parts[1::2]))


# ------------------------------------------------------------------ leaves and places

def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def placed(rows: DataFrame, keys: list[str], order: list[str], tie: str | None = None) -> DataFrame:
    """Adds `place`, from 0 in each key, and `n`, its rows, by order; tie splits runs of
    equal rows over partitions. rows are read twice, once for the range bounds."""
    sort = [F.col(c).asc_nulls_first() for c in [*keys, *order, *([tie] if tie else [])]]
    sorted_ = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            now = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = now != last
            for k in keys:
                column = batch.column(k)
                differ = pc.not_equal(column[1:], column[:-1])
                gap = pc.xor(column[1:].is_null(), column[:-1].is_null())
                new[1:] |= pc.or_(pc.fill_null(differ, False), gap).to_numpy(zero_copy_only=False)
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            local = np.where(start < 0, at + before, at - start)
            last, before = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=[*batch.schema.names, "place"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns)
    numbered = cut(sorted_.withColumn("_part", F.spark_partition_id())
                   .mapInArrow(number, f"{schema}, _part int, place long"))
    names = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    parts = (numbered.groupBy(*names).agg(F.count("*").alias("_n"))
             .withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(whole)})
             .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], "_before", "n"))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)])
    return (numbered.join(parts, same).withColumn("place", F.col("place") + F.col("_before"))
            .select(*rows.columns, "place", "n"))


# ------------------------------------------------------------------ blocks

def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in keys, of sorted batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        turn = np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1
        for a, b in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows]):
            now = tuple(c[a] for c in k)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def blocks(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, round, block, n, runs, nodes): the blocks over nodes (tree, round, place, n,
    digest); n is the number of nodes of the tree in this round."""
    below = FAN ** height

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["tree", "block"]):
            n = rows.column("n")[0].as_py()
            made = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, DIGEST)
            runs = min(height, rounds(n))
            yield pa.RecordBatch.from_pydict({
                "tree": rows.column("tree")[:1].combine_chunks(), "round": rows.column("round")[:1].combine_chunks(),
                "block": rows.column("block")[:1].combine_chunks(), "n": pa.array([n]), "runs": pa.array([runs], pa.int32()),
                "nodes": pa.array([plant(made, runs).tobytes()])})
    return (nodes.withColumn("block", F.floor(F.col("place") / below)).repartition("tree", "block")
            .sortWithinPartitions("tree", "block", "place")
            .mapInArrow(work, "tree long, round int, block long, n long, runs int, nodes binary"))


def roots(made: DataFrame, height: int) -> DataFrame:
    """The blocks' roots as nodes of the next round."""
    return made.select("tree", (F.col("round") + 1).alias("round"), F.col("block").alias("place"),
                       F.ceil(F.col("n") / FAN ** height).alias("n"), F.substring("nodes", 1, DIGEST).alias("digest"))


def grow(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """All blocks of all trees over nodes, round by round."""
    out = None
    while True:
        made = cut(blocks(nodes, height))
        out = made if out is None else out.unionByName(made)
        nodes = roots(made.where(F.col("n") > FAN ** height), height)
        if nodes.isEmpty():
            return out


TOP = -1
"""The tree over the sources; a source's tree has the source's place as its name."""


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(tree, round, place, n, digest, source, doc_id, changed): every row as a leaf in its
    place; changed is the leaf after tampering, where there is any."""
    column = {c: docs[c] for c in fields}
    lower = column | {"text": F.translate(column["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    picked = F.crc32(column["doc_id"].cast("string")) % TAMPER == 0
    rows = docs.select(
        column["source"].alias("source"), column["doc_id"].alias("doc_id"),
        F.unhex(leaf(list(column.values()))).alias("digest"),
        F.when(picked, F.unhex(leaf(list(lower.values())))).alias("changed"),
        F.monotonically_increasing_id().alias("tie"))
    rows = placed(rows, ["source"], ["doc_id", "digest"], "tie").drop("tie")
    sources = placed(rows.where("place = 0").select("source"), [], ["source"])
    named = cut(sources.select(F.col("source").alias("_source"), F.col("place").alias("tree"), F.col("n").alias("_sources")))
    return (rows.join(named, F.col("source").eqNullSafe(F.col("_source")))
            .select("tree", F.lit(0).alias("round"), "place", "n", "digest", "doc_id", "changed",
                    F.col("_sources").alias("sources")))


def manifest(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The blocks of every source's tree and of the tree over the sources."""
    own = grow(nodes, height)
    tops = own.where(F.col("n") <= FAN ** height).select("tree", F.substring("nodes", 1, DIGEST).alias("digest"))
    sources = nodes.select("tree", "sources").where("place = 0")
    over = grow(tops.join(sources, "tree").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("round"),
                                                 F.col("tree").alias("place"), F.col("sources").alias("n"), "digest"), height)
    return own.unionByName(over)


# ------------------------------------------------------------------ proofs

ABOVE = "siblings binary, lengths array<int>, subroot binary, root binary"


class Block:
    """A stored block with what is above it: siblings in hex and their lengths, level by
    level, left and right in turn."""

    def __init__(self, head: dict, height: int):
        self.nodes = np.frombuffer(head["nodes"], np.uint8).reshape(-1, DIGEST)
        self.runs, below = head["runs"], FAN ** height
        self.first = head["block"] * below
        self.n = min(below, head["n"] - self.first)
        self.above = unpacked(head["siblings"], head["lengths"])
        self.subroot = head["subroot"] or head["nodes"][:DIGEST]
        self.root = head["root"] or head["nodes"][:DIGEST]
        self.tails: dict[int, tuple[bytes, Steps]] = {}
        self.folds: dict[tuple[int, bytes], bytes] = {}

    def steps(self, place: int) -> tuple[Steps, bytes, Steps]:
        """The lowest step of a leaf (none in a block of one node); all further ones, as
        bytes and as steps."""
        at = place - self.first
        run = at // FAN
        if run not in self.tails:
            higher = path(self.nodes, self.runs, at, self.n)[1:] + self.above
            self.tails[run] = b"".join(left + right for left, right in higher), higher
        if not self.runs:
            return [], *self.tails[run]
        held, k = run_of(self.nodes, self.runs, self.runs, at, self.n), at % FAN * 2 * DIGEST
        return [(held[:k], held[k + 2 * DIGEST:])], *self.tails[run]

    def proof(self, place: int) -> tuple[bytes, list[int]]:
        low, _, higher = self.steps(place)
        return packed(low + higher)

    def refold(self, place: int, leaf: bytes) -> bytes:
        """The root from a leaf, in hex; what leaves of a run agree in is folded once."""
        low, _, higher = self.steps(place)
        run, value = (place - self.first) // FAN, fold(leaf, low)
        if (run, value) not in self.folds:
            self.folds[run, value] = fold(value, higher)
        return self.folds[run, value]


def meet(made: DataFrame, above: DataFrame, points: DataFrame, answer, schema: str, height: int) -> DataFrame:
    """Points (tree, place and others) in the block of their place: answer gets points
    and, for each, its Block. made: the blocks of one round, above: what is above each
    (tree, block and ABOVE). A block and its points meet in one task."""
    heads = made.select("tree", "block", "n", "runs", "nodes").join(above, ["tree", "block"])
    rows = points.withColumn("block", F.floor(F.col("place") / FAN ** height))
    both = heads.withColumn("place", F.lit(-1).cast("long")).unionByName(rows, allowMissingColumns=True)
    fields = ("n", "runs", "block", "nodes", "siblings", "lengths", "subroot", "root")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            place = batch.column("place").to_numpy()
            heads_at = np.flatnonzero(place < 0).tolist()
            for a, b in zip([0, *heads_at], [*heads_at, len(place)]):
                if a < b and place[a] < 0:
                    block = Block({c: batch.column(c)[a].as_py() for c in fields}, height)
                    a += 1
                if a < b:
                    yield answer(block, batch.slice(a, b - a))
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").mapInArrow(work, schema)


def above_of(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
    """What is above each point: the siblings on its path, in this block and above it."""
    steps = [block.proof(p) for p in batch.column("place").to_pylist()]
    many = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [batch.column("tree"), batch.column("place"), pa.array([x for x, _ in steps], pa.binary()),
         pa.array([x for _, x in steps], pa.list_(pa.int32())), pa.array([block.subroot] * many), pa.array([block.root] * many)],
        names=["tree", "place", "siblings", "lengths", "subroot", "root"])


def top_down(made: DataFrame, tops: DataFrame, height: int) -> list[DataFrame]:
    """What is above every block of the trees in made, by round; tops: above a tree's last
    block (tree and ABOVE)."""
    last = made.agg(F.max("round")).first()[0]
    out: list[DataFrame] = []
    for k in range(-1 if last is None else last, -1, -1):
        here = made.where(F.col("round") == k)
        found = here.where(F.col("n") <= FAN ** height).select("tree", "block").join(tops, "tree")
        if out:
            inner = here.where(F.col("n") > FAN ** height).select("tree", F.col("block").alias("place"))
            upper = meet(made.where(F.col("round") == k + 1), out[-1], inner, above_of, f"tree long, place long, {ABOVE}", height)
            found = found.unionByName(upper.withColumnRenamed("place", "block"))
        out.append(cut(found))
    return out[::-1]


def prove(made: DataFrame, points: DataFrame, answer, schema: str, height: int = HEIGHT) -> DataFrame:
    """Points (tree, place and others), each answered with the Block it lies in."""
    spark = made.sparkSession
    own, over = made.where(F.col("tree") != TOP), made.where(F.col("tree") == TOP)
    start = spark.createDataFrame([(TOP, b"", [], None, None)], f"tree long, {ABOVE}")
    paths = top_down(over, start, height)
    if not paths:
        return spark.createDataFrame([], schema)
    trees = own.where("round = 0 and block = 0").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"))
    tops = meet(over.where("round = 0"), paths[0], trees, above_of, f"tree long, place long, {ABOVE}", height)
    tops = cut(tops.select(F.col("place").alias("tree"), "siblings", "lengths", F.lit(None).cast("binary").alias("subroot"), "root"))
    return meet(own.where("round = 0"), top_down(own, tops, height)[0], points, answer, schema, height)


def check(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Digest of each leaf's proof, and the root folded from what the leaf is now."""
    proofs, folded = [], []
    places, was, now = (batch.column(c).to_pylist() for c in ("place", "digest", "changed"))
    for place, old, new in zip(places, was, now):
        low, tail, _ = block.steps(place)
        proofs.append(hashlib.sha256(b"".join(left + right for left, right in low) + tail).hexdigest())
        folded.append(block.refold(place, (new or old).hex().encode()).decode())
    many, root = batch.num_rows, block.root.hex()
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([x.hex() for x in was]), pa.array([block.subroot.hex()] * many), pa.array([root] * many),
         pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])],
        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def report(docs: DataFrame, fields: tuple[str, ...] = FIELDS, height: int = HEIGHT) -> DataFrame:
    """Leaf, roots, proof and what verification finds, for every row."""
    nodes = cut(leaves(docs, fields))
    made = manifest(nodes, height)
    kind = nodes.schema["doc_id"].dataType.simpleString()
    return prove(made, nodes.select("tree", "place", "doc_id", "digest", "changed"), check,
                 f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", height)


ORACLE = """
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         sha256(enc[1] || enc[2] || enc[3] || enc[4] || enc[5]) AS leaf,
         sha256(enc[1] || enc[2] || enc[3] || enc[4] ||
                translate(enc[5], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lowered,
         xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
             lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 5 = 0 AS picked
  FROM (SELECT *, [CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END FOR x IN
                   [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text]] AS enc FROM documents)),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n FROM leaves),
own AS (
  SELECT tree, 0 AS level, place, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM own WHERE n > 1 GROUP BY tree, level, place // 16, n),
over_ AS (
  SELECT 0 AS level, tree AS place, (SELECT count(DISTINCT tree) FROM placed) AS n, h FROM own WHERE n = 1
  UNION ALL
  SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM over_ WHERE n > 1 GROUP BY level, place // 16, n),
nodes AS MATERIALIZED (
  SELECT 0 AS part, tree, level, place, h FROM own WHERE n > 1
  UNION ALL SELECT 1, 0, level, place, h FROM over_ WHERE n > 1),
steps AS MATERIALIZED (
  SELECT r, part, nodes.level, row_number() OVER (PARTITION BY r ORDER BY part, nodes.level) AS k,
         coalesce(string_agg(h, '' ORDER BY nodes.place) FILTER (nodes.place < floor(pos / 16 ** nodes.level)), '') AS before,
         coalesce(string_agg(h, '' ORDER BY nodes.place) FILTER (nodes.place > floor(pos / 16 ** nodes.level)), '') AS after
  FROM (SELECT r, 0 AS part, tree, CAST(place AS BIGINT) AS pos FROM placed
        UNION ALL SELECT r, 1, 0, CAST(tree AS BIGINT) FROM placed) p
  JOIN nodes USING (part, tree)
  WHERE nodes.place // 16 = CAST(floor(pos / 16 ** (nodes.level + 1)) AS BIGINT)
  GROUP BY r, part, nodes.level, pos),
folded AS (
  SELECT r, CAST(0 AS BIGINT) AS k, CASE WHEN picked THEN lowered ELSE leaf END AS h FROM leaves
  UNION ALL
  SELECT f.r, f.k + 1, sha256(before || f.h || after) FROM folded f JOIN steps s ON s.r = f.r AND s.k = f.k + 1),
roots AS (SELECT tree, h AS subroot FROM own WHERE n = 1),
proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT h FROM over_ WHERE n = 1) AS root,
       coalesce(proof_sha256, sha256('')) AS proof_sha256, f.folded_root,
       f.folded_root = (SELECT h FROM over_ WHERE n = 1) AS verified
FROM placed JOIN roots USING (tree) LEFT JOIN proofs USING (r)
JOIN (SELECT r, max_by(h, k) AS folded_root FROM folded GROUP BY r) f USING (r)
"""
