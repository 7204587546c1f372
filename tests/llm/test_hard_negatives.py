import numpy as np
from pyspark.sql import functions as F

from tessella.llm import hard_negatives as H
from tessella.llm import shards as S

SCHEMA = "vec_id long, embedding array<float>, label int, anchor int, slot string, rank int, vector int"


def vectors():
    """Clusters that labels share, copies, ties, negative scores and rows that take no part."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=9)
        for _ in range(rng.integers(2, 40)):
            rows.append(((centre + rng.normal(size=9) * rng.choice([0.1, 0.4, 0.9])).astype(np.float32).tolist(), int(rng.integers(0, 4))))
    rows += [rows[5]] * 60 + [(rows[5][0], 2)] * 60  # copies, of the same label and another
    rows += [(v, 1) for v in (None, [], [float("nan")] * 9, [1.0, None], [1.0, 2.0], [2.0, 1.0], [0.0] * 9, [-0.3] * 9)]
    rows += [(rows[0][0], None), ([1.0, 2.0], 3), ([2.0, 4.0], 3), ([], 2), ([], 1)]
    ids = rng.permutation(len(rows))
    return [(int(i), v, label, 0, "x", 7, 1) for i, (v, label) in zip(ids, rows)]


def brute(rows, every=50, moved=True):
    good = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if moved and i % 7 == 0 else label
        good.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for a, label, q in good:
        if a % every:
            continue
        scored = sorted((-sum(p * r for p, r in zip(q, v)), i, other) for i, other, v in good if i != a and len(v) == len(q))
        for s, p, other in [x for x in scored if x[2] == label][:H.POSITIVES]:
            inside = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:H.NEGATIVES]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(inside, 1)]
    return sorted(out)


def test_as_brute_force_over_many_shards(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    assert len(want) > 20
    got = H.report(df)
    assert [c for c, _ in got.dtypes] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want
    all_ = H.mine(df, F.col("vec_id") % 3 == 0, shard_values=300)
    assert sorted(map(tuple, all_.collect())) == brute(rows, 3, False)


def test_empty_repeated_and_lone_rows(spark):
    assert H.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, [1.0, 0.0], 1, 0, "", 0, 0), (1, [1.0, 0.0], 1, 0, "", 0, 0), (2, [0.75, 0.5], 2, 0, "", 0, 0), (None, [1.0], 1, 0, "", 0, 0)]
    want = [(0, 1, 1, 2, 65536, 49152)]
    assert sorted(map(tuple, H.mine(spark.createDataFrame(rows * 3, SCHEMA), F.col("vec_id") == 0).collect())) == want
    assert H.report(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0


def test_first_and_exact_scores():
    scores = np.array([[3, 5, 5, S.NONE, 5, 1], [S.NONE] * 6])
    assert [x.tolist() for x in S.first(scores, 2)] == [[0, 0], [1, 2]]
    big = np.array([[2 ** 40, 3]])
    assert S.dots(big, np.array([[2 ** 20, 5], [2 ** 40, 0]])).tolist() == [[2 ** 60 + 15, S.LARGEST]]
