"""Automaton, gram filter and the scores built on them, against plain Python."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessella.data import entities as ed
from tessella.data import sentiment as sd
from tessella.functions import automaton as au
from tessella.functions import text as tx
from tessella.operators import grams
from tessella.operators import sentiment as sn


def places(text, word):
    return [p for p in range(len(text)) if text.startswith(word, p)]


def test_automaton_finds_every_occurrence():
    rng = random.Random(2)
    for _ in range(200):
        letters = rng.choice(["ab", "abc好不", "abcdefgh😀"])
        made = au.Automaton("".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 12)))
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(letters + "x", k=rng.choice([0, 3, 50, 700]))) for _ in range(5)]
        codes, begins = au.characters(pa.array(texts, pa.string()))
        start, word = made.find(codes)
        assert sorted((int(s), made.words[w]) for s, w in zip(start, word)) == sorted(
            (int(begins[i]) + p, w) for i, t in enumerate(texts) for w in made.words for p in places(t or "", w))
        text = begins.searchsorted(start, side="right") - 1
        taken = au.apart(text, start, word, made.length)
        assert sorted((int(t), made.words[w]) for t, w, k in zip(text, word, taken) if k) == sorted(
            (i, w) for i, t in enumerate(texts) for w in made.words for _ in range((t or "").count(w)))


def test_runs_take_whole_texts():
    texts = pa.array(["a" * 5, None, "b" * 30, "", "c" * 4, "d" * 4])
    assert [len(r) for r in au.runs(texts, 10)] == [2, 1, 3] and list(au.runs(pa.array([], pa.string()))) == []


def factor(before, table):
    return next((v for w, v in table if w in before), 1.0)


def brute_scores(text, lexicon, chinese):
    """(lexicon, sentence) score by the definitions."""
    window = 4 if chinese else 5
    degrees = sorted(sd.INTENSIFIERS, key=lambda r: -len(r[0]))

    def at(t, p):
        return factor(t[max(0, p - window):p], sd.NEGATIONS) * factor(t[max(0, p - window):p], degrees)
    text, lexicon = (text, lexicon) if chinese else (text.lower(), [(w.lower(), v) for w, v in lexicon])
    values = [v * at(text, m.start()) for w, v in lexicon for m in re.finditer(re.escape(w), text)]
    if chinese:
        values += [-1.2 * v for w, v in lexicon if v > 0 for n in sd.NEGATED_POSITIVE for _ in range(text.count(n + w))]
    means = []
    for s in re.split(sd.SENTENCE_SPLIT, text):
        found = [v * (at(s, s.index(w)) if chinese else 1) for w, v in lexicon if w in s]
        means += [sum(found) / len(found)] if found else []
    return tuple(sum(x) / len(x) if x else 0.0 for x in (values, means))


def test_scores_equal_the_definitions(spark):
    rng = random.Random(4)
    pieces = [w for w, _ in sd.LEXICON + sd.NEGATIONS + sd.INTENSIFIERS] + sd.NEGATED_POSITIVE + [" ", " ", ". ", "。", "!\n", "The", "和", "Good", "NOT "]
    texts = ["".join(rng.choices(pieces, k=rng.choice([0, 1, 5, 40, 400]))) for _ in range(150)] + ["", "  ", None]
    lexicon = [*sd.LEXICON, ("good", 0.3), ("GOOD", 0.1), ("oo", -0.2), ("aa", 1.0), ("", 9.0)]
    texts += ["aaaa aaa. aa", "not aaaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("l", tx.language_by_majority(F.col("text")))
    got = df.select("id", "l", sn.lexicon_score(F.col("text"), F.col("l"), lexicon), sn.sentence_score(F.col("text"), F.col("l"), lexicon)).collect()
    for i, language, a, b in got:
        if texts[i] is None:
            assert a is None and b is None
            continue
        want = brute_scores(texts[i], [x for x in lexicon if x[0]], language == "chinese")
        assert abs(a - want[0]) < 1e-9 and abs(b - want[1]) < 1e-9, texts[i]
    table = spark.createDataFrame([*lexicon, (None, 1.0), ("x", None)], "word string, weight double")
    assert df.select(sn.lexicon_score(F.col("text"), F.col("l"), table)).collect() == [(r[2],) for r in got]


def test_a_large_lexicon_table_held_or_joined(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(25_000)}
    table = spark.createDataFrame([(w, 1.0) for w in words] + [("aba", 2.0), ("abab", 1.0)], "word string, weight double")
    texts = ["".join(rng.choices("abcdefgh ", k=rng.choice([5, 80]))) for _ in range(30)] + ["ababababa", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = [tuple(r) for r in table.collect()]
    want = sorted((i, w, v, m.start()) for i, t in enumerate(texts) for w, v in rows if t and w in t for m in re.finditer(w, t))
    assert sorted(map(tuple, sn.lexicon_matches(df, "id", table).collect())) == want
    assert sorted(map(tuple, sn.lexicon_matches(df, "id", table, held_words=10).collect())) == want
    assert sn.lexicon_matches(df, "id", table.limit(0)).count() == sn.lexicon_matches(df, "id", table.limit(0), held_words=-1).count() == 0


def test_grams_near_names_only(spark):
    """What leaves the texts is little more than what is found, whatever the texts hold."""
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200_000))
    names = [text[p:p + n] for p, n in ((5, 7), (900, 4), (900, 9), (199_990, 10), (40, 2))] + ["qqqqqqqq", "北京大学"]
    df = spark.createDataFrame([(1, text), (2, "北京大学大学"), (3, None), (4, "")], "id long, text string")
    table = spark.createDataFrame([(n, "T") for n in names] + [("", "T"), (None, "T")], "name string, type string")
    want = sorted((i, p, n) for i, t in ((1, text), (2, "北京大学大学")) for n in names for p in places(t, n))
    assert sorted(map(tuple, grams.gram_join(df, "id", table, "name").select("id", "start", "name").collect())) == want
    assert len(want) <= grams.grams(df, "id", table.where("name <> ''"), "name").count() <= 1.1 * len(want) + 20
    assert grams.gram_join(df, "id", table.limit(0), "name").count() == 0
    assert grams.grams(df, "id", table.limit(0), "name").count() == 0


def test_strings_that_patterns_need(spark):
    assert tx.needed(r"(five|5) star(s)?") == (" star",) and tx.needed("(坑|坑爹|被骗).*?x+y?") == ("坑", "被骗")
    assert tx.needed(r"\ba\.b[cd]{2}(?<!q)efg(?:h|i)*") == ("a.b",) and tx.needed("a?b*[xyz]") == () == tx.needed("(?i)abc")
    patterns = [p for p, _ in [*sd.PATTERNS, *sd.ENGLISH_PATTERNS, *ed.TIME_PATTERNS, *ed.ENGLISH_TIMES]]
    told = [x for p in patterns for x in tx.needed(p)]
    rng = random.Random(5)
    parts = [*told, *"ſKıİ 5年月日一二半19-/:", "dont BUY", "Stopped  working", "ſtopped workıng", "five stars", "非常 很精彩", "体验很好", "2024-01-05", "May 5", None]
    texts = [None if None in x and i % 9 == 0 else "".join(y or " " for y in x) for i, x in enumerate(rng.choices(parts, k=9) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")

    def plain(language):
        general, latin = sd.PATTERNS[:-1], sd.PATTERNS[-1:]
        every = [(p, v, "diu" if language == "english" else "d", F.col("text")) for p, v in [*general, *latin]]
        if language == "english":
            every += [(p, v, "d", F.lower("text")) for p, v in sd.ENGLISH_PATTERNS]
        return sum((F.regexp_count(on, F.lit(f"(?{flags}){p}")) * v for p, v, flags, on in every), F.lit(0.0))
    for language in ("english", "chinese"):
        got = rows.select(sn.pattern_score(F.col("text"), F.lit(language)).alias("got"), plain(language).alias("want")).collect()
        assert all((r["got"] is None) == (r["want"] is None) and (r["got"] is None or abs(r["got"] - r["want"]) < 1e-9) for r in got)
    for p in patterns:
        held = tx.holds(F.col("text"), p, 99)
        assert held is None or rows.where(F.col("text").rlike(p) & ~held).count() == 0


def test_words_counted_where_texts_meet(spark):
    """Stemmed counts and keywords as from plain counts, without shuffles of their own."""
    from tessella.operators import text as ops
    df = spark.createDataFrame([(1, "running run Runs x"), (1, "running sing"), (2, None), (3, ""), (4, "run sing sing")], "id int, text string")
    stems = spark.createDataFrame([("running", "run"), ("sing", "s")], "term string, stem string")
    found = ops.stemmed_counts(df, ["id"], stems)
    want = ops.stem(ops.term_counts(df, ["id"]), ["id"], stems)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and (1, "run", 3) in set(map(tuple, found.collect()))
    plan = ops.tfidf_keywords(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and ", term#" not in "".join(x for x in plan.split("\n") if "hashpartitioning(id#" in x)


def test_hits_of_many_runs(spark, monkeypatch):
    """Hits become columns run by run; the parts make one answer, texts without hits and NULL included."""
    taken = []
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda fn: taken.append(fn) or (lambda c: c))
    sn._hits(F.lit(""), [("ab", 1.0)], "word:string,weight:double,position:long",
             lambda text, word, weight, at: {"word": word, "weight": weight, "position": at})
    real = au.runs
    monkeypatch.setattr(au, "runs", lambda texts: real(texts, 4))
    out = taken[0](pa.array(["xab", None, "", "abab", "zzzz"]))
    assert [[h["position"] for h in hits] for hits in out.to_pylist()] == [[1], [], [], [0, 2], []]
    assert taken[0](pa.array([], pa.string())).to_pylist() == []
