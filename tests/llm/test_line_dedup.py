import random

import pyarrow as pa

from tessella.llm import line_dedup as L


def lone_lines(rows, least):
    """Lines of enough words that an earlier document holds: any alignment has them as blocks."""
    first, out = {}, {}
    for i, t in sorted(rows):
        for line in {x.strip(" \t\n\r\x0b\x0c") for x in t.split("\n")}:
            if len(line.split()) >= least:
                first.setdefault(line, i)
    for i, t in rows:
        out[i] = [first.get(x.strip(" \t\n\r\x0b\x0c"), i) < i for x in t.split("\n")]
    return out


def test_patience_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(8) for _ in range(rng.randint(0, 12))]
        b = [rng.randrange(8) for _ in range(rng.randint(0, 12))]
        found = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))
        if not set(a) & set(b):
            assert not found
    assert L.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert L.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_blocks_need_words():
    assert L.deleted_places([1, 2, 3], [1, 2, 9], [2, 2, 9], 5) == []
    assert L.deleted_places([1, 2, 3], [1, 2, 9], [2, 3, 9], 5) == [0, 1]
    assert sorted(L.deleted_places([1, 2], [2, 1], [7, 7], 5)) == [0, 1]  # moved
    assert L.deleted_places([1, 1, 4], [1, 5], [7, 7, 7], 5) == [0, 1]  # repeated


def test_lines_that_an_earlier_document_holds_go(spark):
    rng = random.Random(5)
    line = [f"line {k} of some {'many ' * (k % 4)}words" for k in range(60)]
    rows = [(i, "\n".join(rng.choice([*line, "hm", "", f"own {i}"]) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, "passage " * 80 + "\nown line of this one"), (503, "passage " * 80)]
    got = {r.doc_id: r for r in L.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    want = lone_lines(rows, L.LEAST_WORDS)
    for i, t in rows:
        lines = t.split("\n")
        must = [x for x, gone in zip(lines, want[i]) if not gone and len(x.split()) >= L.LEAST_WORDS]
        left = got[i].text.split("\n")
        assert [x for x in left if len(x.split()) >= L.LEAST_WORDS] == must
        # An empty text is no line or an empty one.
        assert got[i].n_deleted in ({len(lines) - len(left)} if got[i].text else {len(lines), len(lines) - 1})
    assert got[503].text == "" and got[502].n_deleted == 0


def test_odd_rows(odd_docs, no_docs):
    got = L.dedup(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, odd_docs.collect()))
    assert L.dedup(no_docs).count() == 0


def slow_aligner(later, earlier, words, least):
    """The largest common block by dynamic programming, then the largest with a line that
    is still there, until no block has enough words."""
    gone = set()
    while True:
        best = []
        length = [[0] * (len(earlier) + 1) for _ in range(len(later) + 1)]
        for i in range(len(later)):
            for j in range(len(earlier)):
                if later[i] == earlier[j]:
                    n = length[i + 1][j + 1] = length[i][j] + 1
                    block = range(i + 1 - n, i + 1)
                    if sum(words[k] for k in block) >= least and set(block) - gone and len(block) > len(best):
                        best = block
        if not best:
            return sorted(gone)
        gone.update(best)


def test_alignments_find_what_a_slow_aligner_finds():
    assert L.deleted_places([7, 8, 9, 1, 2, 3], [1, 2, 3, 7, 8, 9], [2] * 6, 5) == [0, 1, 2, 3, 4, 5]  # moved, short lines
    rng = random.Random(9)
    for _ in range(400):
        count = [0, 1, 2, 3, 6]
        a, b = ([rng.randint(1, 9) for _ in range(rng.randint(0, 14))] for _ in range(2))
        words = [count[x % 5] for x in a]
        want = slow_aligner(a, b, words, 5)
        assert L.deleted_places(a, b, words, 5) == want
        gone = set(rng.sample(want, len(want) // 2))  # what another alignment took is not aligned again
        assert set(L.deleted_places(a, b, words, 5, gone)) | gone >= set(want)


def test_order_decides_before_what_moved():
    """One alignment holds the longest rising part; the block that crosses it is left to the next."""
    a, b = [1, 2, 3, 4, 5], [4, 5, 1, 2, 3]
    assert L.aligned(list(range(5)), a, b, [5] * 5, 5) == [0, 1, 2]
    assert L.aligned([3, 4], a, b, [5] * 5, 5) == [3, 4]
    assert list(map(list, L.anchored([1, 1, 4], [1, 5, 1], [7] * 3, 5, set()))) == [[0], [1]]


def test_rare_runs_choose_the_pairs(spark):
    """Documents 2 and 3 share a passage; the frequent line goes with it, unaligned with its first holder."""
    line = "a line that very many documents hold"
    rows = [(0, f"{line}\nown nought")] + [(k, f"own {k}\n{line}") for k in range(10, 60)]
    rows += [(2, f"rare words of the passage here\n{line}\nend"), (3, f"x\nrare words of the passage here\n{line}\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    real = L.align
    L.align = lambda pairs, *a: seen.append(sorted((r.doc.did, r.first.did) for r in pairs.collect())) or real(pairs, *a)
    try:
        got = {r.doc_id: r.text for r in L.report(df).collect()}
    finally:
        L.align = real
    assert seen == [[(3, 2)], sorted([(2, 0), *((k, 0) for k in range(10, 60))])]
    assert got[3] == "x\ny" and got[2] == "rare words of the passage here\nend" and got[10] == "own 10" and got[0] == rows[0][1]


def test_words_of_lines():
    lines = ["", "one", " two  words ", "naïve café", "春眠 x", "日本語のab", "ไทย", "a\tb\x0bc", "“quoted” – dash", "ok"]
    assert L.count_words(pa.array(lines)).tolist() == [0, 1, 2, 2, 3, 5, 3, 3, 3, 1]
    assert L.count_words(pa.array([], pa.string())).tolist() == []


def test_blocks_of_short_lines_are_found(spark):
    verse = "\n".join(f"verse {k} line" for k in range(200))
    table = "\n".join(f"cell {k}" for k in range(50))
    chinese = "\n".join(["春眠不觉晓", "处处闻啼鸟", "夜来风雨声", "花落知多少"])
    head = "a long line that the first of all holds already"
    rows = [(1, f"{head}\nown one"), (2, f"{head}\n{table}\nown two"), (3, f"own three\n{head}\n{table}"),
            (4, verse), (5, f"own five\n{verse}"), (6, chinese), (7, f"诗\n{chinese}"), (8, "own one\nown eight"),
            (9, "start of it all now here\nshort tail"), (10, "start of it all now here\nother"), (11, "x\nstart of it all now here\nother")]
    got = {r.doc_id: r.text for r in L.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {1: f"{head}\nown one", 2: f"{table}\nown two", 3: "own three", 4: verse, 5: "own five", 6: chinese, 7: "诗",
                   8: "own one\nown eight", 9: "start of it all now here\nshort tail", 10: "other", 11: "x"}
