import collections

import numpy as np

from tessella.llm import vector_join as V


def brute(rows):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None
            for _, v, label in rows]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups = collections.defaultdict(list)
    for k, (_, v, label) in enumerate(rows):
        if good[k]:
            groups[label, len(v)].append(k)
    for members in groups.values():
        x = np.array([rows[k][1] for k in members], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= V.COSINE, 1))):
            a, b = members[a], members[b]
            degree[a], degree[b] = degree[a] + 1, degree[b] + 1
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, degree[k], least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(rows))


def vectors():
    rng = np.random.default_rng(1)
    rows = []
    for c in range(25):
        centre = rng.normal(size=18)
        for _ in range(rng.integers(1, 40)):
            rows.append(((centre + rng.normal(size=18) * rng.choice([0.05, 0.1, 0.14, 0.2])).astype(np.float32).tolist(), c % 3))
    rows += [rows[3 * k] for k in range(20)]  # equal vectors
    rows += [(v, 0) for v in (None, [], [0.0] * 18, [float("nan")] * 18, [float("inf")] * 18, [1.0, None], [1.0, 2.0],
                              [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0], [1e-30, 2e-30])] + [(rows[0][0], None)]
    ids = rng.permutation(len(rows))
    return [(int(i), v, label) for i, (v, label) in zip(ids, rows)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_links_as_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert any(n > 5 for _, n, _, _ in want)
    for limit in (V.TILE_ROWS, 7):  # the second splits most cells
        assert sorted(map(tuple, V.join(df, tile_rows=limit).collect())) == want


def test_empty_and_repeated_ids(spark):
    assert V.join(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], SCHEMA)
    assert sorted(map(tuple, V.join(twice).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
