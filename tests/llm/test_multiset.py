import hashlib

import numpy as np
import pyarrow as pa

from tessella.llm import multiset as M


def print_of(*texts):
    return M.sums(pa.array(texts))


def test_order_insertion_deletion():
    a, b, c = "first paragraph of words\n", "second one, of other words\n", "third\n"
    assert M.spelled(print_of(a + b + c)) == M.spelled(print_of(c + a + b))
    assert M.spelled(M.add(print_of(a + b), print_of(c))) == M.spelled(print_of(a + b + c))
    assert M.spelled(M.remove(print_of(a + b + c), print_of(b))) == M.spelled(print_of(a + c))
    assert M.spelled(print_of(a + a)) != M.spelled(print_of(a))


def test_likeness():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(2000)]
    x, y = (" ".join(rng.choice(words, 600)) for _ in range(2))
    half = x[:len(x) // 2] + y[:len(y) // 2]
    assert M.alike(print_of(x), print_of(x))[0] == 1
    assert M.alike(print_of(x), print_of(y))[0] < 0.35
    assert 0.3 < M.alike(print_of(x), print_of(half))[0] < 0.7
    assert M.alike(print_of(""), print_of(""))[0] == 1 and M.alike(print_of(""), print_of("a"))[0] == 0


def check(rows, docs):
    """Against the texts edited one by one."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[:len(t) - third] + following[:third]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), M.spelled(print_of(t))[0], M.spelled(print_of(e))[0],
                     float(M.alike(print_of(t), print_of(e))[0]), float(M.alike(print_of(t), print_of(following))[0])))
    got = [tuple(r) for r in M.compare_edits(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_edits_and_next(spark, odd_docs, no_docs):
    check([(r.doc_id, r.text) for r in odd_docs.collect()], odd_docs)
    rows = [(k * 7 % 1000, f"text {k}\nof {'é' * (k % 50)} paragraphs\n" * (k % 9)) for k in range(300)]
    check(rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    check(rows[:1], spark.createDataFrame(rows[:1], "doc_id long, text string"))
    assert M.compare_edits(no_docs).count() == 0 and M.fingerprints(no_docs).count() == 0
