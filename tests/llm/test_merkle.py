import hashlib
import zlib

import numpy as np
import pytest

from tessella.llm import merkle as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    def enc(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][k:k + 16])) for k in range(0, len(out[-1]), 16)])
        return out

    def steps(tree, at):
        for level in tree[:-1]:
            a = at // 16 * 16
            yield level[a:at], level[at + 1:a + 16]
            at //= 16
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaf = lambda r, text: h("".join(map(enc, (r[0], r[3], r[2], r[4], text))))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: levels([leaf(r, r[1]) for r in own[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for k, r in enumerate(own[s]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            way = [*steps(trees[s], k), *steps(top, i)]
            value = leaf(r, text)
            for before, after in way:
                value = h("".join(before) + value + "".join(after))
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], h("".join("".join(b + a) for b, a in way)), value,
                        value == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def many():
    rng = np.random.default_rng(5)
    rows = [(int(i), f"Text {i % 7} Über", None if i % 11 == 0 else "de", "hot", int(i) % 90) for i in rng.permutation(600)]
    rows += [(1000 + i, "A b", "en", f"s{i:02d}", 3) for i in range(40)]
    rows += [(2000 + i, None, "en", None, None) for i in range(17)] + [(3000, "X", None, "é", 1), (3001, "y", None, "z", 1)]
    return rows


@pytest.mark.parametrize("height", [1, 3])  # the first needs several rounds of blocks
def test_as_brute_force(spark, height):
    rows = many()
    got = M.report(spark.createDataFrame(rows, SCHEMA).repartition(5), height=height)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r)[:5] for r in odd_docs.collect()]
    got = sorted(map(tuple, M.report(odd_docs).collect()), key=str)
    assert got == brute(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert M.report(no_docs).collect() == []


def test_one_row(spark):
    rows = [(10, "Abc", "en", "s", 3)]
    assert list(map(tuple, M.report(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_layout():
    """Addresses are a permutation; the children of a node stand together, with it in
    one small subtree at every second depth; any node's path proves it."""
    for levels in (1, 2, 3, 4):
        at = np.concatenate([M.places(levels, d) for d in range(levels)])
        assert sorted(at.tolist()) == list(range(M.size(levels)))
    four = [M.places(4, d) for d in range(4)]
    assert four[0][0] == 0 and four[1].tolist() == list(range(1, 17))
    assert (four[3].reshape(256, 16) == four[2][:, None] + 1 + np.arange(16)).all()
    for n in (1, 2, 16, 17, 300):
        leaves = np.frombuffer(b"".join(hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(n)), np.uint8).reshape(n, 32)
        nodes = M.plant(leaves, 3)
        for k in range(0, n, 7):
            assert M.fold(leaves[k].tobytes().hex().encode(), M.path(nodes, 3, k, n)) == nodes[0].tobytes().hex().encode()
