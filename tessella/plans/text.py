"""Text mining queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import text as ops
from tessella.plans import sqlparts as sp
from tessella.plans.registry import query
from tessella.session import cut
from tessella.sources.tables import spread, table

R6 = 6


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _stop(spark):
    return ops.stopword_table(spark)


def _counts(spark, d, min_length=1):
    return ops.term_counts(_docs(spark, d), ["doc_id"], _stop(spark), min_length)


LANG_SQL = f"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '{tx.CJK}')) AS cjk,
                  len(regexp_extract_all(text, '{tx.LATIN}')) AS latin FROM documents)
SELECT doc_id, """


@query("lang_detect_ratio", LANG_SQL + """CASE WHEN cjk + latin = 0 THEN 'unknown'
  WHEN cjk::DOUBLE / (cjk + latin) > 0.7 THEN 'chinese'
  WHEN cjk::DOUBLE / (cjk + latin) < 0.3 THEN 'english' ELSE 'mixed' END AS language FROM c""")
def lang_detect_ratio(spark, d):
    return _docs(spark, d).select("doc_id", tx.language_by_ratio(F.col("text")).alias("language"))


@query("lang_detect_30", LANG_SQL + """CASE WHEN cjk + latin > 0
  AND cjk::DOUBLE / (cjk + latin) > 0.3 THEN 'chinese' ELSE 'english' END AS language FROM c""")
def lang_detect_30(spark, d):
    return _docs(spark, d).select(
        "doc_id", tx.language_by_threshold(F.col("text")).alias("language"))


@query("lang_detect_majority", LANG_SQL.replace(tx.CJK, tx.CJK_NARROW) + """
  CASE WHEN cjk >= latin THEN 'chinese' ELSE 'english' END AS language FROM c""")
def lang_detect_majority(spark, d):
    return _docs(spark, d).select(
        "doc_id", tx.language_by_majority(F.col("text")).alias("language"))


@query("tokenize_en", f"""
SELECT doc_id, len(t) AS total_words, md5(array_to_string(t, ' ')) AS words,
  md5(array_to_string(list_filter(t, lambda w: w NOT IN ({sp.STOP_EN})), ' ')) AS kept_words
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents)""")
def tokenize_en(spark, d):
    from tessella.data.stopwords import ENGLISH
    t = _docs(spark, d).withColumn("t", tx.words_en(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("total_words"),
                    F.md5(F.array_join("t", " ")).alias("words"),
                    F.md5(F.array_join(F.filter("t", lambda w: ~w.isin(*ENGLISH)), " "))
                    .alias("kept_words"))


@query("tokenize_unicode", r"""
SELECT doc_id, len(t) AS total_words, md5(array_to_string(t, ' ')) AS words FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents)""")
def tokenize_unicode(spark, d):
    """Words with accents, whole."""
    t = _docs(spark, d).withColumn("t", tx.words_unicode(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("total_words"), F.md5(F.array_join("t", " ")).alias("words"))


@query("tokenize_zh", f"""
SELECT conv_id, turn, array_to_string({sp.words_zh('text')}, '|') AS tokens FROM conversations""")
def tokenize_zh(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(tx.words_zh(F.col("text")), "|").alias("tokens"))


def _clean(name, col_fn, sql_expr):
    @query(name, f"SELECT doc_id, length(c) AS n_chars, md5(c) AS cleaned FROM "
                 f"(SELECT doc_id, {sql_expr} AS c FROM documents)")
    def run(spark, d):
        c = _docs(spark, d).select("doc_id", col_fn(F.col("text")).alias("c"))
        return c.select("doc_id", F.length("c").cast("long").alias("n_chars"),
                        F.md5("c").alias("cleaned"))
    return run


_clean("clean_punct_zh", tx.strip_punctuation, sp.strip_punctuation("text"))
_clean("clean_text_en", tx.clean_en, sp.squeeze(
    rf"""regexp_replace(text, '[^a-zA-Z0-9{tx.SPACE_SET}.,!?''"\-]', '', 'g')"""))
_clean("clean_text_zh", tx.clean_zh, sp.squeeze(
    rf"regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}a-zA-Z0-9{tx.SPACE_SET}]', '', 'g')"))


@query("strip_html", f"""SELECT page_id, length(c) AS n_chars, md5(c) AS plain FROM
  (SELECT page_id, regexp_replace(html, '{tx.TAG}', '', 'g') AS c FROM pages)""")
def strip_html(spark, d):
    c = table(spark, d, "pages").select("page_id", tx.strip_html(F.col("html")).alias("c"))
    return c.select("page_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("plain"))


@query("stopword_filter", f"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
SELECT doc_id, count(*) AS kept, count(DISTINCT term) AS kept_unique FROM tok
WHERE term NOT IN ({sp.STOP_EN}) GROUP BY doc_id""")
def stopword_filter(spark, d):
    counts = ops.term_counts(_docs(spark, d), ["doc_id"], _stop(spark))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("kept"), F.count("*").alias("kept_unique"))


@query("stopword_count", f"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
SELECT doc_id, count(*) AS stopwords FROM tok WHERE term IN ({sp.STOP_EN}) GROUP BY doc_id""")
def stopword_count(spark, d):
    terms = ops.explode_terms(_docs(spark, d), ["doc_id"], tx.words_en(F.col("text")))
    return ops.keep_stopwords(terms, _stop(spark)).groupBy("doc_id").agg(
        F.count("*").alias("stopwords"))


@query("stopword_lists", f"""
WITH lines AS (SELECT lower(trim(unnest(string_split(text, chr(10))), ' ')) AS term
               FROM conversations WHERE role = 'system'),
allw AS (SELECT term, 'custom' AS language FROM lines WHERE term <> '' AND term NOT LIKE '#%'
  UNION ALL SELECT unnest([{sp.STOP_EN}]), 'english'
  UNION ALL SELECT unnest([{sp.word_list(ops.defaults.CHINESE)}]), 'chinese')
SELECT DISTINCT term, language FROM allw""")
def stopword_lists(spark, d):
    lines = (table(spark, d, "conversations").where(F.col("role") == "system")
             .select(F.explode(F.split("text", "\n")).alias("line")))
    return ops.stopword_table(spark, lines)


STEMS_SQL = """stems AS (SELECT DISTINCT term, left(term, length(term) - 3) AS stem FROM tok
                         WHERE term LIKE '%ing' AND length(term) > 5)"""


def _stems(counts):
    return (counts.where(F.col("term").endswith("ing") & (F.length("term") > 5))
            .select("term", F.expr("left(term, length(term) - 3)").alias("stem")).distinct())


@query("stem_tokens", f"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
{STEMS_SQL}
SELECT doc_id, coalesce(s.stem, tok.term) AS term, count(*) AS n
FROM tok LEFT JOIN stems s ON tok.term = s.term GROUP BY ALL""")
def stem_tokens(spark, d):
    docs = _docs(spark, d)
    stems = cut(_stems(ops.term_counts(docs, [])))
    return ops.stemmed_counts(docs, ["doc_id"], stems)


RANK = "row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term)"


@query("word_frequency", f"""WITH {sp.COUNTS}
SELECT * FROM (SELECT doc_id, term, n, {RANK} AS rank FROM cnt WHERE length(term) >= 2) WHERE rank <= 10""")
def word_frequency(spark, d):
    return ops.top_terms(_counts(spark, d, 2), ["doc_id"], 10).withColumn(
        "rank", F.col("rank").cast("long"))


@query("corpus_word_frequency", f"""WITH {sp.COUNTS}
SELECT term, sum(n)::BIGINT AS n FROM cnt WHERE length(term) >= 2 GROUP BY term
ORDER BY n DESC, term LIMIT 10""")
def corpus_word_frequency(spark, d):
    return ops.corpus_word_frequency(_docs(spark, d), _stop(spark), 10)


@query("word_frequency_share", f"""WITH {sp.COUNTS},
r AS (SELECT doc_id, term, n, {RANK} AS rank FROM cnt)
SELECT doc_id, term, n, rank, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY doc_id), 6) AS percent
FROM r WHERE rank <= 20""")
def word_frequency_share(spark, d):
    return ops.share_of_shown(_counts(spark, d), ["doc_id"], 20).select(
        "doc_id", "term", "n", F.col("rank").cast("long"), F.round("percent", R6).alias("percent"))


@query("keywords_by_frequency", f"""WITH {sp.COUNTS},
r AS (SELECT doc_id, term, n, {RANK} AS rank FROM cnt WHERE length(term) >= 3)
SELECT doc_id, term, n, rank, round(n::DOUBLE / max(n) OVER (PARTITION BY doc_id), 6) AS weight
FROM r WHERE rank <= 10""")
def keywords_by_frequency(spark, d):
    return ops.keywords(_counts(spark, d, 3), ["doc_id"], 10).select(
        "doc_id", "term", "n", F.col("rank").cast("long"), F.round("weight", R6).alias("weight"))


STAT_LONGS = ["total_chars", "total_words", "valid_words", "unique_words", "stopword_count"]


@query("text_stats_en", f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS t,
  length(regexp_replace(text, '[\\n ]', '', 'g')) AS chars,
  len(list_filter(regexp_split_to_array(text, '{tx.SENTENCE_END}'),
      lambda s: regexp_matches(s, '{tx.NON_SPACE}'))) AS sentences,
  len(list_filter(regexp_split_to_array(text, '{tx.PARAGRAPH_GAP}'),
      lambda s: regexp_matches(s, '{tx.NON_SPACE}'))) AS paragraphs FROM documents),
v AS (SELECT *, list_filter(t, lambda x: x NOT IN ({sp.STOP_EN})) AS k FROM w)
SELECT doc_id, chars AS total_chars, len(t) AS total_words, len(k) AS valid_words,
  len(list_distinct(k)) AS unique_words, len(t) - len(k) AS stopword_count,
  sentences, paragraphs,
  round(CASE WHEN len(t) > 0 THEN chars::DOUBLE / len(t) ELSE 0 END, 6) AS avg_word_length,
  round(CASE WHEN sentences > 0 THEN len(t)::DOUBLE / sentences ELSE 0 END, 6) AS avg_sentence_length
FROM v""")
def text_stats_en(spark, d):
    s = ops.text_stats_en(_docs(spark, d))
    return s.select("doc_id", *[F.col(c).cast("long") for c in STAT_LONGS + ["sentences", "paragraphs"]],
                    F.round("avg_word_length", R6).alias("avg_word_length"),
                    F.round("avg_sentence_length", R6).alias("avg_sentence_length"))


@query("text_stats_zh", f"""
WITH w AS (SELECT conv_id, turn, length(regexp_replace(text, '[\\n ]', '', 'g')) AS chars,
  {sp.words_zh('text')} AS t FROM conversations),
v AS (SELECT *, list_filter(t, lambda x: x NOT IN ({sp.STOP_ALL})) AS k FROM w)
SELECT conv_id, turn, chars AS total_chars, len(t) AS total_words, len(k) AS valid_words,
  len(list_distinct(k)) AS unique_words, len(t) - len(k) AS stopword_count FROM v""")
def text_stats_zh(spark, d):
    return ops.text_stats_zh(table(spark, d, "conversations")).select(
        "conv_id", "turn", *[F.col(c).cast("long") for c in STAT_LONGS])


@query("term_frequency", f"""WITH {sp.COUNTS}
SELECT doc_id, term, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY doc_id), 6) AS tf FROM cnt""")
def term_frequency(spark, d):
    return ops.term_frequency(_counts(spark, d), ["doc_id"]).withColumn("tf", F.round("tf", R6))


IDF = """nd AS (SELECT count(*)::DOUBLE AS n_docs FROM documents),
idf AS (SELECT term, count(*) AS df, ln((SELECT n_docs FROM nd) / (count(*) + 1)) + 1 AS idf
        FROM cnt GROUP BY term)"""


@query("inverse_document_frequency", f"""WITH {sp.COUNTS}, {IDF}
SELECT term, df, round(idf, 6) AS idf FROM idf""")
def inverse_document_frequency(spark, d):
    return ops.inverse_document_frequency(_counts(spark, d), _docs(spark, d)).withColumn(
        "idf", F.round("idf", R6))


TFIDF = f"""{sp.COUNTS}, {IDF},
tf AS (SELECT doc_id, term, n, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS tf FROM cnt),
w AS (SELECT doc_id, term, round(tf * idf, 6) AS weight FROM tf JOIN idf USING (term))"""


@query("tfidf", f"WITH {TFIDF} SELECT doc_id, term, weight FROM w")
def tfidf(spark, d):
    return ops.tfidf(_counts(spark, d), _docs(spark, d), ["doc_id"]).select(
        "doc_id", "term", F.round("weight", R6).alias("weight"))


@query("tfidf_keywords", f"""WITH {TFIDF},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM w)
SELECT doc_id, term, weight, rank FROM r WHERE rank <= 10""")
def tfidf_keywords(spark, d):
    return ops.tfidf_keywords(_docs(spark, d), ["doc_id"], _stop(spark)).select(
        "doc_id", "term", "weight", F.col("rank").cast("long"))


@query("tfidf_l2", f"""WITH {sp.COUNTS},
c2 AS (SELECT * FROM cnt WHERE length(term) >= 2),
nd AS (SELECT count(*)::DOUBLE AS n_docs FROM documents),
vocab AS (SELECT term, sum(n) AS total, ln((1 + (SELECT n_docs FROM nd)) / (1 + count(*))) + 1 AS idf
          FROM c2 GROUP BY term ORDER BY total DESC, term LIMIT 1000),
raw AS (SELECT doc_id, term, n * idf AS w FROM c2 JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""")
def tfidf_l2(spark, d):
    return ops.tfidf_l2(_counts(spark, d, 2), _docs(spark, d), ["doc_id"]).select(
        "doc_id", "term", F.round("weight", R6).alias("weight"))


@query("wordcloud_weights", f"""WITH {sp.COUNTS}, tok2 AS (SELECT DISTINCT term FROM cnt),
stems AS (SELECT term, left(term, length(term) - 3) AS stem FROM tok2
          WHERE term LIKE '%ing' AND length(term) > 5),
st AS (SELECT coalesce(stem, cnt.term) AS term, n FROM cnt LEFT JOIN stems ON cnt.term = stems.term),
t AS (SELECT term, sum(n)::BIGINT AS n FROM st GROUP BY term ORDER BY n DESC, term LIMIT 100)
SELECT term, n, round(n::DOUBLE / max(n) OVER (), 6) AS weight FROM t""")
def wordcloud_weights(spark, d):
    counts = ops.term_counts(_docs(spark, d), [], _stop(spark))  # of the corpus: nothing is asked by document
    return ops.wordcloud_weights(ops.stem(counts, [], _stems(counts)), 100).withColumn(
        "weight", F.round("weight", R6))


@query("corpus_overview", "SELECT count(*) AS documents, sum(length(text))::BIGINT AS total_chars FROM documents")
def corpus_overview(spark, d):
    return ops.corpus_overview(_docs(spark, d))


def _history(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"),
        F.col("o_orderdate").alias("created_at"))


@query("history_page", """SELECT o_orderkey AS id, o_orderpriority AS kind,
  strftime(o_orderdate, '%Y-%m-%d') AS created_on FROM orders WHERE o_orderpriority = '1-URGENT'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""")
def history_page(spark, d):
    return ops.history_page(_history(spark, d), "1-URGENT", 20, 40).select(
        "id", "kind", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


@query("history_stats", "SELECT o_orderpriority AS kind, count(*) AS analyses FROM orders GROUP BY ALL")
def history_stats(spark, d):
    return ops.history_stats(_history(spark, d))


@query("document_search", """
SELECT path, name FROM (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path,
  doc_id || '.txt' AS name FROM documents) WHERE lower(path) LIKE '%src1/%' OR lower(name) LIKE '%src1/%'""")
def document_search(spark, d):
    docs = table(spark, d, "documents").select(
        F.format_string("%s/%s/%d.txt", "source", "lang", "doc_id").alias("path"),
        F.format_string("%d.txt", "doc_id").alias("name"), F.col("doc_id").alias("created_at"))
    return ops.document_search(docs, "SRC1/").select("path", "name")
