"""Sentiment queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.data import sentiment as sd
from tessella.functions import text as tx
from tessella.operators import sentiment as sn
from tessella.plans.registry import query
from tessella.plans.sqlparts import values
from tessella.sources.tables import spread, table

LEX = values(sd.LEXICON, "word, weight")
TEXT = ("concat(text, CASE doc_id % 6 WHEN 0 THEN ' 😀😀 not good! so very happy.' WHEN 1 THEN ' 😡 worst ever; a waste of time' "
        "WHEN 2 THEN ' I would definitely recommend it, 5 stars 👍' WHEN 3 THEN ' never again. Refund! 😞😐' ELSE '' END)")
DOCS = f"docs AS (SELECT doc_id, {TEXT} AS text FROM documents)"


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", F.expr(TEXT).alias("text")))


def _chain(rows, col="before"):
    return "CASE " + " ".join("WHEN contains({c}, '{w}') THEN {v}".format(c=col, w=w.replace("'", "''"), v=v)
                              for w, v in rows) + " ELSE 1.0 END"


NEG = _chain(sd.NEGATIONS)
INT = _chain(sorted(sd.INTENSIFIERS, key=lambda r: -len(r[0])))
HITS = f"""{DOCS}, lex AS {LEX},
pc AS (SELECT doc_id, lower(text) AS t, lower(word) AS word, weight, string_split(lower(text), lower(word)) AS p
  FROM docs, lex WHERE contains(lower(text), lower(word))),
ps AS (SELECT *, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(word))::BIGINT AS position
  FROM (SELECT *, unnest(range(1, len(p))) AS i FROM pc)),
hits AS (SELECT doc_id, word, weight::DOUBLE AS weight, position, substr(t, greatest(position - 5, 0)::INTEGER + 1, least(position, 5)::INTEGER) AS before FROM ps),
fac AS (SELECT *, ({NEG})::DOUBLE AS negation, ({INT})::DOUBLE AS intensity FROM hits)"""


@query("lexicon_matches", f"""WITH {DOCS}, lex AS {LEX},
pc AS (SELECT doc_id, word, weight, string_split(text, word) AS p FROM docs, lex WHERE contains(text, word))
SELECT doc_id, word, weight::DOUBLE AS weight, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(word))::BIGINT AS position
FROM (SELECT *, unnest(range(1, len(p))) AS i FROM pc)""")
def lexicon_matches(spark, d):
    return sn.lexicon_matches(_docs(spark, d), "doc_id")


TABLE = """lex AS (SELECT DISTINCT word, (length(word) % 7 - 3) / 4.0 AS weight FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS word FROM conversations))"""


@query("lexicon_table_matches", f"""WITH {DOCS}, {TABLE}, pc AS (SELECT doc_id, word, weight, string_split(text, word) AS p FROM docs, lex WHERE contains(text, word))
SELECT doc_id, word, weight::DOUBLE AS weight, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(word))::BIGINT AS position
FROM (SELECT *, unnest(range(1, len(p))) AS i FROM pc)""")
def lexicon_table_matches(spark, d):
    """Thousands of words, taken from another table."""
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("word"))
    lexicon = words.distinct().withColumn("weight", (F.length("word") % 7 - 3) / 4.0)
    return sn.lexicon_matches(_docs(spark, d), "doc_id", lexicon)


@query("negation_multiplier", f"WITH {HITS} SELECT doc_id, word, before, negation FROM fac")
def negation_multiplier(spark, d):
    return sn.context_factors(_docs(spark, d), "doc_id").drop("intensity")


@query("intensifier_multiplier", f"WITH {HITS} SELECT doc_id, word, before, intensity FROM fac")
def intensifier_multiplier(spark, d):
    return sn.context_factors(_docs(spark, d), "doc_id").drop("negation")


LANG = (f"CASE WHEN len(regexp_extract_all(text, '{tx.CJK_NARROW}')) >= len(regexp_extract_all(text, '{tx.LATIN}')) "
        "THEN 'chinese' ELSE 'english' END")


def _patterns(rows, on, flags):
    return " + ".join("len(regexp_extract_all({o}, '{f}{p}')) * {v}::DOUBLE".format(
        o=on, f=flags, p=p.replace("'", "''"), v=v) for p, v in rows)


SCORES = f"""{HITS}, lang AS (SELECT doc_id, text, {LANG} AS language FROM docs),
lx AS (SELECT doc_id, sum(weight * negation * intensity) / count(*) AS s FROM fac GROUP BY ALL),
pt AS (SELECT doc_id, CASE language WHEN 'chinese' THEN {_patterns(sd.PATTERNS, 'text', '')}
  ELSE {_patterns(sd.PATTERNS, 'text', '(?i)')} + {_patterns(sd.ENGLISH_PATTERNS, 'lower(text)', '')} END AS s FROM lang),
em AS (SELECT doc_id, sum(n * v)::DOUBLE / sum(n) AS s FROM (SELECT doc_id, len(string_split(text, e)) - 1 AS n, v FROM docs, {values(sd.EMOJI, 'e, v')} x) GROUP BY ALL HAVING sum(n) > 0),
sc AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS s FROM (SELECT doc_id, regexp_split_to_array(lower(text), '{sd.SENTENCE_SPLIT}') AS p FROM docs)),
sm AS (SELECT doc_id, i, avg(weight::DOUBLE) AS m FROM sc, lex WHERE contains(s, lower(word)) GROUP BY ALL),
se AS (SELECT doc_id, avg(m) AS s FROM sm GROUP BY ALL),
scores AS (SELECT doc_id, text, language, CASE language WHEN 'english' THEN coalesce(lx.s, 0) ELSE 0 END AS lexicon_score, pt.s AS pattern_score,
  CASE language WHEN 'english' THEN coalesce(se.s, 0) ELSE 0 END AS sentence_score, coalesce(em.s, 0) AS emoji_score
  FROM lang LEFT JOIN lx USING (doc_id) LEFT JOIN pt USING (doc_id) LEFT JOIN em USING (doc_id) LEFT JOIN se USING (doc_id)),
bl AS (SELECT *, greatest(-1.0, least(1.0, lexicon_score * 0.5 + pattern_score * 0.2 + sentence_score * 0.15 + emoji_score * 0.15)) AS raw_score FROM scores),
final AS (SELECT *, greatest(0.01, least(0.99, (raw_score + 1) / 2)) AS p FROM bl)"""


def _score(name, column):
    @query(name, f"WITH {SCORES} SELECT doc_id, round({column}::DOUBLE, 10) AS score FROM scores")
    def run(spark, d):
        t, lang = F.col("text"), tx.language_by_majority(F.col("text"))
        fn = {"lexicon_score": sn.lexicon_score, "pattern_score": sn.pattern_score,
              "sentence_score": sn.sentence_score}.get(name)
        return _docs(spark, d).select("doc_id", F.round(
            fn(t, lang) if fn else sn.emoji_score(t), 10).alias("score"))
    return run


for _n in ("lexicon_score", "pattern_score", "sentence_score", "emoji_score"):
    _score(_n, _n)


@query("sentiment", f"""WITH {SCORES} SELECT doc_id, language, CASE WHEN p >= 0.5 THEN 'positive' ELSE 'negative' END AS sentiment,
CASE WHEN NOT regexp_matches(text, '{tx.NON_SPACE}') THEN '正面' WHEN p >= 0.8 THEN '非常正面' WHEN p >= 0.65 THEN '比较正面' WHEN p >= 0.5 THEN '正面' WHEN p <= 0.2 THEN '非常负面'
  WHEN p <= 0.35 THEN '比较负面' ELSE '负面' END AS sentiment_name,
round(p::DOUBLE, 10) AS positive_score, round(raw_score::DOUBLE, 10) AS raw_score, round(greatest(0.5, least(0.99, 0.5 + abs(p - 0.5)))::DOUBLE, 10) AS confidence FROM final""")
def sentiment(spark, d):
    return sn.sentiment(_docs(spark, d)).select(
        "doc_id", "language", "sentiment", "sentiment_name",
        *[F.round(c, 10).alias(c) for c in ("positive_score", "raw_score", "confidence")])


@query("sentiment_gauge", f"""WITH {SCORES} SELECT doc_id, CASE WHEN p <= 0.2 THEN '非常负面' WHEN p <= 0.4 THEN '比较负面'
WHEN p <= 0.6 THEN '中性' WHEN p <= 0.8 THEN '比较正面' ELSE '非常正面' END AS band FROM final""")
def sentiment_gauge(spark, d):
    return sn.sentiment(_docs(spark, d)).select("doc_id", sn.gauge(F.col("positive_score")).alias("band"))


@query("sentiment_distribution", f"""WITH {SCORES} SELECT count(*) FILTER (p >= 0.5) AS positive, count(*) FILTER (p < 0.5) AS negative,
round(avg(p::DOUBLE), 6) AS average_positive_score, round(avg(greatest(0.5, least(0.99, 0.5 + abs(p - 0.5)))::DOUBLE), 6) AS average_confidence, count(*) AS total FROM final""")
def sentiment_distribution(spark, d):
    s = sn.distribution(sn.sentiment(_docs(spark, d)))
    return s.withColumns({c: F.round(c, 6) for c in ("average_positive_score", "average_confidence")})
