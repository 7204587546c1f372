import random
import re

import pytest

from tessella.llm import mixing


def fill(sizes, weights, budget):
    """Water-filling, one clamp at a time."""
    clamped = set()
    while True:
        free = [s for s in sizes if s not in clamped]
        level = (budget - sum(2 * sizes[s] for s in clamped)) / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if level * weights[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in clamped else level * weights[s] for s in sizes}
        clamped.add(max(over, key=lambda s: level * weights[s] / sizes[s] if sizes[s] else 1e9))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(k, "w " * rng.choice([1, 5, 20, 200]) + f"e{k}", rng.choice(["a", "b", "c", "d", "é", None, "Z"]) if k > 300 else "a")
           for k in range(900)]
    return out + [(7, "w w", "tiny"), (7, "w w", "tiny"), (8, None, "none")]


def test_targets_and_words(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.report(mixing.mix(docs)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2, s
    again = mixing.report(mixing.mix(docs.repartition(2))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rows_of_the_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.report(mixing.mix(docs)).collect()
    mixed = mixing.repeat(docs).collect()
    assert sum(r.taken for r in plan) == sum(len((r.text or "").split()) for r in mixed)
    whole = {(i, t) for i, t, _ in rows}
    cut_short = [r for r in mixed if (r.doc_id, r.text) not in whole]
    assert len(cut_short) <= 9
    for r in cut_short:
        assert any(t.startswith(r.text) for i, t in whole if i == r.doc_id and t)


def test_odd_rows(odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == odd_docs.count()
    assert mixing.repeat(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.repeat(no_docs).count() == 0
