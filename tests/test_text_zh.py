"""Chinese behaviour on small inline texts, checked against plain Python."""

import re

from pyspark.sql import functions as F

from tessella.data import sentiment as sd
from tessella.functions import text as tx
from tessella.operators import sentiment as sn


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()[0]


def test_languages_disagree(spark):
    t = F.col("text")
    for text, ratio, third, majority in [("", "unknown", "english", "chinese"), ("好好好好", "chinese", "chinese", "chinese"),
                                         ("ab好好", "mixed", "chinese", "chinese"), ("abcdefg好", "english", "english", "english")]:
        assert _one(spark, text, tx.language_by_ratio(t)) == ratio
        assert _one(spark, text, tx.language_by_threshold(t)) == third
        assert _one(spark, text, tx.language_by_majority(t)) == majority


def test_words_zh(spark):
    got = _one(spark, "我喜欢，Python3！ 123 好", tx.words_zh(F.col("text")))
    assert got == ["我喜", "喜欢", "Python3", "好"]


def test_punctuation(spark):
    assert _one(spark, " 你好，世界！(a-b)…【c】 ", tx.strip_punctuation(F.col("text"))) == "你好 世界 a b c"


def brute_lexicon(text):
    language = "chinese" if len(re.findall("[一-龥]", text)) >= len(re.findall("[a-zA-Z]", text)) else "english"
    body, width = (text, 4) if language == "chinese" else (text.lower(), 5)
    total, n = 0.0, 0

    def factor(prefix):
        neg = next((f for w, f in sd.NEGATIONS if w in prefix), 1.0)
        inten = max(((len(w), -i, f) for i, (w, f) in enumerate(sd.INTENSIFIERS) if w in prefix), default=(0, 0, 1.0))[2]
        return neg * inten
    for word, value in sd.LEXICON:
        for m in re.finditer(re.escape(word if language == "chinese" else word.lower()), body):
            total += value * factor(body[max(0, m.start() - width):m.start()])
            n += 1
    if language == "chinese":
        for word, value in sd.POSITIVE:
            for neg in sd.NEGATED_POSITIVE:
                k = body.count(neg + word)
                total, n = total - 1.2 * value * k, n + k
    return total / n if n else 0.0


def test_lexicon_score_matches_plain_python(spark):
    texts = ["这个产品非常好，我很喜欢！", "不好，太差了，没有优秀的地方。", "真的非常满意😀😀但是不推荐", "好好好 垃圾垃圾",
             "This is not good, so very bad. Love it!", "", "   "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(sn.lexicon_score(F.col("text"), tx.language_by_majority(F.col("text")))).collect()]
    assert [round(g, 9) for g in got] == [round(brute_lexicon(t), 9) for t in texts]


def test_sentiment_labels(spark):
    df = spark.createDataFrame([("很好，强烈推荐！",), ("垃圾产品，非常失望，千万别买",), ("  ",)], "text string")
    got = [(r["sentiment"], r["positive_score"]) for r in sn.sentiment(df).collect()]
    assert got[0][0] == "positive" and got[1][0] == "negative" and got[2] == ("positive", 0.5)


def test_model_score_changes_only_chinese(spark):
    df = spark.createDataFrame([("很好", -1.0), ("good", -1.0)], "text string, m double")
    base = [r["raw_score"] for r in sn.sentiment(df).collect()]
    with_model = [r["raw_score"] for r in sn.sentiment(df, model_score="m").collect()]
    assert with_model[0] < base[0] and with_model[1] == base[1]


def test_cleaning_equals_the_plain_patterns(spark):
    """Runs go at once and single blanks stay; characters of all kinds against one-by-one removal."""
    import random
    rng = random.Random(2)
    signs = [*map(chr, range(1, 256)), "  ", " ", "中", "鿿", "，", "é", "😀", "　", " ", "\x85", "ab"]
    df = spark.createDataFrame([("".join(rng.choices(signs, k=rng.randint(0, 60))),) for _ in range(800)] + [(None,), ("".join(signs),)], "text string")
    t = F.col("text")

    def plain(removed):
        return F.trim(F.regexp_replace(F.regexp_replace(t, removed, ""), f"{tx.SPACE}+", " "))
    assert df.where(~tx.clean_en(t).eqNullSafe(plain(rf"""[^a-zA-Z0-9{tx.SPACE_SET}.,!?'"\-]"""))).count() == 0
    assert df.where(~tx.clean_zh(t).eqNullSafe(plain(rf"[^\x{{4e00}}-\x{{9fff}}a-zA-Z0-9{tx.SPACE_SET}]"))).count() == 0
