import numpy as np
from pyspark.sql import functions as F

from tessella.llm import ball_tree as B
from test_hard_negatives import SCHEMA, vectors


def brute(rows, every, k):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, q in good:
        if a % every == 0:
            scored = sorted((-sum(p * r for p, r in zip(q, v)), i) for i, v in good if i != a and len(v) == len(q))
            out += [(a, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_as_brute_force_over_many_shards(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = B.report(df)
    assert [c for c, _ in got.dtypes] == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 50, 5)
    some = B.search(df, F.col("vec_id") % 3 == 0, k=3, shard_values=300)
    assert sorted(map(tuple, some.collect())) == brute(rows, 3, 3)


def test_empty_repeated_and_lone_rows(spark):
    assert B.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, [1.0, 0.0], None, 0, "", 0, 0), (1, [1.0, 0.0], 1, 0, "", 0, 0), (None, [1.0, 1.0], 1, 0, "", 0, 0)]
    assert list(map(tuple, B.report(spark.createDataFrame(rows * 3, SCHEMA)).collect())) == [(0, 1, 1, 65536)]
    assert B.report(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0


def test_bounds_hold_and_prune():
    """No vector scores above a node that holds it, and a near query opens few leaves."""
    rng = np.random.default_rng(0)
    x = np.floor(256 * (rng.normal(size=(40, 1, 8)) * 9 + rng.normal(size=(40, 50, 8)) * 0.3).reshape(-1, 8)).astype(np.int64)
    tree = B.BallTree(np.arange(len(x)), x, 5)
    q = x[::97]
    norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    for node, (_, _, a, b) in enumerate(tree.nodes):
        bound = tree.bound(q.astype(float), norm, np.full(len(q), node))
        assert ((q @ tree.x[a:b].T).max(axis=1) <= bound).all()
    opened = []
    leaf = tree.leaf
    tree.leaf = lambda node, who, *rest: opened.append(len(who)) or leaf(node, who, *rest)
    row, ids, scores = tree.search(np.full(len(q), -1), q, np.full(len(q), B.S.NONE + 1))
    assert sum(opened) < 0.3 * len(q) * (tree.child < 0).sum()
    for k in range(len(q)):
        want = sorted(zip((-(x @ q[k])).tolist(), range(len(x))))[:5]
        assert list(zip((-scores[row == k]).tolist(), ids[row == k].tolist())) == want


def test_copies_are_kept_only_as_far_as_they_count():
    tree = B.BallTree(np.arange(5000)[::-1].copy(), np.tile([[3, 4]], (5000, 1)), 5)
    assert sorted(tree.ids.tolist()) == [0, 1, 2, 3, 4, 5]
    row, ids, _ = tree.search(np.array([2]), np.array([[1, 1]]), np.array([B.S.NONE + 1]))
    assert ids.tolist() == [0, 1, 3, 4, 5]
