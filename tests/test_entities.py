"""Span folds against a plain Python replay of the same rules."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessella.data import entities as ed
from tessella.functions import automaton as au
from tessella.functions import spans as sp
from tessella.functions import text as tx
from tessella.operators import entities as en


def brute_resolve(spans):
    out = []
    for s in sorted(spans, key=lambda x: (x[0], -(x[1] - x[0]), -x[4])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
            continue
        p = out[-1]
        gap, plen, slen = s[4] - p[4], p[1] - p[0], s[1] - s[0]
        if (gap > 0.10 or plen <= 2 or (p[3] == "LOC" and p[2][:1] in ed.WEAK_PLACE_PREFIX)
                or (s[3] == "PER" and p[3] == "LOC" and len(s[2]) <= 4 and s[4] >= 0.85)
                or (s[3] == "TIME" and p[3] != "TIME" and s[4] >= 0.90)
                or (slen > plen * 1.5 and gap > -0.05)):
            out[-1] = s
    return out


def brute_merge(spans, text):
    out = []
    for s in spans:
        p = out[-1] if out else None
        if (p and p[3] == s[3] and 0 < s[0] - p[1] <= 2 and text[p[1]:s[0]].strip() in ed.JOINERS):
            out[-1] = (p[0], s[1], text[p[0]:s[1]], p[3], (p[4] + s[4]) / 2)
        else:
            out.append(s)
    return out


def test_resolve_and_merge(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("在于北京王a b·-") for _ in range(60))
    cases = []
    for i in range(40):
        spans = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, 55)
            b = min(60, a + rng.randint(1, 7))
            spans.append((a, b, text[a:b], rng.choice(list(ed.TYPES)), rng.choice([0.8, 0.83, 0.85, 0.9, 0.92, 0.95])))
        cases.append((i, text, spans))
    df = spark.createDataFrame(cases, f"id int, text string, spans {sp.SPAN}")
    df = df.withColumn("r", en.resolve_overlaps(F.col("spans")))
    got = df.select("id", "r", en.merge_adjacent(F.col("r"), F.col("text")).alias("m")).orderBy("id").collect()
    for row, (_, _, spans) in zip(got, cases):
        want = brute_resolve(spans)
        assert [tuple(x) for x in row["r"]] == want
        assert [tuple(x) for x in row["m"]] == brute_merge(want, text)


def test_pattern_offsets_match_finditer(spark):
    text = "2024-01-05 与 10:30，1999年3月，昨天12月5日 2001 20011"
    df = spark.createDataFrame([(text,)], "text string")
    for pattern, _ in ed.TIME_PATTERNS:
        got = df.select(sp.matches(F.col("text"), pattern)).first()[0]
        assert [(r[0], r[1]) for r in got] == [(m.start(), m.group()) for m in re.finditer(pattern, text)]


def test_overlapping_occurrences(spark):
    df = spark.createDataFrame([("aaab aa",), ("baaa",)], "text string")
    got = [r[0] for r in df.select(sp.occurrences(F.col("text"), F.lit("aa"))).collect()]
    assert got == [[0, 1, 5], [1, 2]]


def test_recognize_chinese_and_english(spark):
    df = spark.createDataFrame([(1, "王小明先生，北京大学讲人工智能，2024年1月5日"), (2, "Dr. Anna Smith met Google on 2024-01-05"),
                                (3, "")], "id int, text string")
    found = {}
    names = [("北京大学", "ORG", 0.9), ("人工智能", "NOUN", 0.9)]
    for r in en.entity_rows(en.recognize(df, "id", names), "id").collect():
        found.setdefault(r["id"], set()).add((r["type"], r["text"]))
    assert {("PER", "王小明先生"), ("ORG", "北京大学"), ("NOUN", "人工智能"), ("TIME", "2024年1月5日")} <= found[1]
    assert {("PER", "Dr. Anna Smith"), ("ORG", "Google"), ("TIME", "2024-01-05")} <= found[2]
    assert 3 not in found


def test_names_of_a_table_held_or_joined(spark):
    """The same spans either way; NULL, empty and repeated names, texts without any."""
    df = spark.createDataFrame([(1, "北京大学的Anna说aaaa"), (2, None), (3, ""), (4, "x")], "id int, text string")
    table = spark.createDataFrame([("北京", "LOC", 0.92), ("北京大学", "ORG", 0.9), ("aa", "NOUN", 0.9), ("aa", "LOC", 0.7),
                                   ("", "LOC", 0.9), (None, "LOC", 0.9)], "name string, type string, confidence double")
    a, b = (sorted(map(tuple, en.span_rows(en.with_candidates(df, "id", table, held_names=n), "id", F.col("candidates")).collect()))
            for n in (100, 1))
    assert a == b and sum(r[3] == "aa" for r in a) == 6 and {r[3] for r in a} >= {"北京", "北京大学"}
    assert sorted(map(tuple, en.entity_rows(en.recognize(df, "id", table), "id").collect())) == sorted(
        map(tuple, en.entity_rows(en.recognize(df, "id", table, held_names=1), "id").collect()))


def test_highlight(spark):
    rows = en.recognize(spark.createDataFrame([(1, "在北京说")], "id int, text string"), "id", [("北京", "LOC", 0.92)])
    out = rows.select(en.highlight(rows)).first()[0]
    assert out.startswith("在<span") and out.endswith("</span>说") and "北京<sub>地点</sub>" in out


def test_quick_patterns_find_the_same(spark):
    """Patterns with a look ahead, endings by first letter and gates against the plain ones."""
    rng = random.Random(3)
    parts = ["Acme", "ſky", "Kelvin", "İnc", "ıt", "A", "of", "x.y", "Co.", "co", "Corp", "GROUP", "UnıOn", "Lımıted", "Holdingſ", "Inc.", "Éa", "State",
             "Mt.", "Mount", "Mountain", "Dr.", "Anna", "Smith", "May 5, 2024", "Fall", "today", "2024-01-05", "1999", "10:30 am", "北京", "\n", "  ", "?", "_"]
    texts = [None, ""] + ["".join(rng.choice(parts) + rng.choice([" ", " ", "", "\t"]) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").cache()
    t = F.col("text")
    pairs = [("(?iu)" + ed.ENGLISH_ORG, tx.ahead(en.quick_org())), (ed.ENGLISH_LOCATION, tx.ahead(tx.by_first(ed.ENGLISH_LOCATION)))]
    pairs += [(p, tx.ahead(p)) for p in [ed.ENGLISH_TITLED, ed.ENGLISH_NAME, *(p for p, _ in ed.ENGLISH_TIMES), *(p for p, _ in ed.TIME_PATTERNS)]]
    pairs += [(p[0], en.CJK_NEXT + p[0]) for p in ed.SUFFIX_PATTERNS]
    for plain, quick in pairs:
        assert df.where(~sp.matches(t, plain).eqNullSafe(sp.matches(t, quick))).count() == 0, quick
    assert df.where(t.rlike("(?iu)" + ed.ENGLISH_ORG) & ~t.rlike(r"\s" + en.org_ending())).count() == 0
    assert df.where(t.rlike(en.quick_org())).count() > 50


def test_steps_laid_out_or_followed(monkeypatch):
    """A small automaton steps by a table and finds what the links find."""
    rng = random.Random(4)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(80)}
    codes, _ = au.characters(pa.array(["".join(rng.choices("abcd", k=900)) for _ in range(5)] + [None, ""]))
    small = au.Automaton(words)
    found = small.find(codes)
    assert small._steps() is not None and "_next" not in small.__getstate__()
    monkeypatch.setattr(au, "DENSE_CELLS", 0)
    again = au.Automaton(words).find(codes)
    assert len(found[0]) > 500 and all((a == b).all() for a, b in zip(found, again))
