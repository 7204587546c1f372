"""Token tables, frequencies, statistics and TF-IDF in long form.

Every operator takes documents as (key columns, text) and keeps terms in rows,
so a long document or a hot term is spread by Spark instead of growing one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.data import stopwords as defaults
from tessella.functions import text as tx
from tessella.functions.bounds import bounded_broadcast, literal_table
from tessella.functions.rows import unnest


def stopword_table(spark: SparkSession, custom: DataFrame | None = None,
                   english=defaults.ENGLISH, chinese=defaults.CHINESE) -> DataFrame:
    """(term, language): both default lists, then custom lines without
    comments; a custom word applies to either language."""
    rows = [(w, "english") for w in english] + [(w, "chinese") for w in chinese]
    table = literal_table(spark, rows, "term string, language string")
    if custom is not None:
        lines = custom.select(F.lower(F.trim("line")).alias("term"))
        lines = lines.where((F.col("term") != "") & ~F.col("term").startswith("#"))
        table = table.unionByName(lines.withColumn("language", F.lit("custom")))
    return table.distinct()


def word_language(term: Column) -> Column:
    return F.when(term.rlike(tx.CJK), "chinese").otherwise("english")


def explode_terms(docs: DataFrame, keys: list[str], words: Column) -> DataFrame:
    return unnest(docs, keys, words, "term")


def drop_stopwords(terms: DataFrame, stop: DataFrame) -> DataFrame:
    """Anti join before any shuffle; the script of the word picks its list."""
    s = bounded_broadcast(stop.select(F.col("term").alias("s_term"),
                                      F.col("language").alias("s_lang")))
    return terms.join(s, (terms.term == s.s_term)
                      & s.s_lang.isin("custom", word_language(terms.term)), "left_anti")


def keep_stopwords(terms: DataFrame, stop: DataFrame) -> DataFrame:
    s = bounded_broadcast(stop.select(F.col("term").alias("s_term"),
                                      F.col("language").alias("s_lang")))
    return terms.join(s, (terms.term == s.s_term)
                      & s.s_lang.isin("custom", word_language(terms.term)), "left_semi")


def term_counts(docs: DataFrame, keys: list[str], stop: DataFrame | None = None,
                min_length: int = 1, words=tx.words_en, text: str = "text") -> DataFrame:
    """(keys, term, n). Counts combine map-side because a document is one row."""
    terms = explode_terms(docs, keys, words(F.col(text)))
    if min_length > 1:
        terms = terms.where(F.length("term") >= min_length)
    if stop is not None:
        terms = drop_stopwords(terms, stop)
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("n"))


def stem(counts: DataFrame, keys: list[str], stems: DataFrame) -> DataFrame:
    """Replace words by their stem where one is known. Joining counted terms
    instead of raw tokens keeps a hot word at one row per document."""
    joined = counts.join(stems.select("term", "stem"), "term", "left")
    return (joined.select(*keys, F.coalesce("stem", "term").alias("term"), "n")
            .groupBy(*keys, "term").agg(F.sum("n").alias("n")))


HELD_STEMS = 1_000_000
"""Stems up to which they are broadcast."""


def stemmed_counts(docs: DataFrame, keys: list[str], stems: DataFrame, text: str = "text") -> DataFrame:
    """As `stem` of the counts of all words. Texts meet by key first, so words are counted where they are
    written out, and with stems few enough to be broadcast again by their stems: only texts are shuffled."""
    held = bounded_broadcast(stems.select(F.col("term").alias("s_term"), "stem"), HELD_STEMS)
    terms = explode_terms(docs.select(*keys, text).repartition(*keys), keys, tx.words_en(F.col(text)))
    counts = terms.groupBy(*keys, "term").agg(F.count("*").alias("n"))
    joined = counts.join(held, counts["term"] == held["s_term"], "left")
    return (joined.select(*keys, F.coalesce("stem", "term").alias("term"), "n")
            .groupBy(*keys, "term").agg(F.sum("n").alias("n")))


def top_terms(counts: DataFrame, keys: list[str], top_n: int, by: str = "n") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc("term"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def share_of_shown(counts: DataFrame, keys: list[str], top_n: int) -> DataFrame:
    """Percent of the total of the rows shown, not of the document."""
    shown = top_terms(counts, keys, top_n)
    total = F.sum("n").over(Window.partitionBy(*keys))
    return shown.withColumn("percent", F.col("n") * 100.0 / total)


def keywords(counts: DataFrame, keys: list[str], top_n: int = 10) -> DataFrame:
    """Weight relative to the most frequent term of the document."""
    shown = top_terms(counts, keys, top_n)
    return shown.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy(*keys)))


def text_stats_en(docs: DataFrame, stop_words=defaults.ENGLISH, text: str = "text") -> DataFrame:
    """One map-only pass; nothing is shuffled."""
    body = F.col(text)
    words = docs.withColumn("w", tx.words_en(body))
    words = words.withColumn("v", F.filter("w", lambda t: ~t.isin(*stop_words)))
    n_words, chars = F.size("w"), tx.visible_chars(body)
    sentences = tx.non_blank_pieces(body, tx.SENTENCE_END)
    return words.withColumns({
        "total_chars": chars, "total_words": n_words,
        "valid_words": F.size("v"), "unique_words": F.size(F.array_distinct("v")),
        "stopword_count": n_words - F.size("v"),
        "sentences": sentences,
        "paragraphs": tx.non_blank_pieces(body, tx.PARAGRAPH_GAP),
        "avg_word_length": F.when(n_words > 0, chars / n_words).otherwise(0.0),
        "avg_sentence_length": F.when(sentences > 0, n_words / sentences).otherwise(0.0),
    }).drop("w", "v")


def text_stats_zh(docs: DataFrame, stop_words=tuple(defaults.CHINESE + defaults.ENGLISH),
                  text: str = "text") -> DataFrame:
    words = docs.withColumn("w", tx.words_zh(F.col(text)))
    words = words.withColumn("v", F.filter("w", lambda t: ~t.isin(*stop_words)))
    return words.withColumns({
        "total_chars": tx.visible_chars(F.col(text)), "total_words": F.size("w"),
        "valid_words": F.size("v"), "unique_words": F.size(F.array_distinct("v")),
        "stopword_count": F.size("w") - F.size("v"),
    }).drop("w", "v")


def term_frequency(counts: DataFrame, keys: list[str]) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("tf", F.col("n") / total)


def inverse_document_frequency(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """ln(N/(df+1)) + 1. Counts hold one row per (document, term), so df needs no
    distinct; N arrives as a scalar subquery. Asking for n keeps this side's shuffle
    of the counts the same as the other side's, so tokens are counted once."""
    n_docs = docs.select(F.count("*").alias("n")).scalar()
    df = counts.groupBy("term").agg(F.count_if(F.col("n") > 0).alias("df"))
    return df.withColumn("idf", F.log(n_docs / (F.col("df") + 1)) + 1)


def tfidf(counts: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """The idf side has one row per term, so a hot term is a skewed join whose
    heavy side AQE splits (or a broadcast when the vocabulary is small)."""
    idf = inverse_document_frequency(counts, docs).select("term", "idf")
    return (term_frequency(counts, keys).join(idf, "term")
            .withColumn("weight", F.col("tf") * F.col("idf")))


def tfidf_keywords(docs: DataFrame, keys: list[str], stop: DataFrame | None = None,
                   top_n: int = 10, text: str = "text") -> DataFrame:
    """Texts meet by key before their words are written out: counts, sums and ranks of a text need
    no shuffle of their own, and only words of the idf side leave it."""
    counts = term_counts(docs.select(*keys, text).repartition(*keys), keys, stop, text=text)
    weights = tfidf(counts, docs, keys).withColumn("weight", F.round("weight", 6))
    return top_terms(weights, keys, top_n, by="weight")


HELD_TERMS = 200_000
"""Vocabularies up to which the terms are broadcast."""


def tfidf_l2(counts: DataFrame, docs: DataFrame, keys: list[str],
             max_features: int = 1000) -> DataFrame:
    """Smoothed idf over the most frequent terms, unit length per document."""
    n_docs = docs.select(F.count("*").alias("n")).scalar()
    vocabulary = (counts.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("df"))
                  .orderBy(F.desc("total"), F.asc("term")).limit(max_features)
                  .withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1))
    known = vocabulary.select("term", "idf")  # as many rows as the caller asks for
    raw = (counts.join(F.broadcast(known) if max_features <= HELD_TERMS else known, "term")
           .withColumn("raw", F.col("n") * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return raw.withColumn("weight", F.col("raw") / norm).drop("raw")


def wordcloud_weights(counts: DataFrame, max_words: int) -> DataFrame:
    """Corpus counts of the largest words, scaled by the largest."""
    top = (counts.groupBy("term").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), F.asc("term")).limit(max_words))
    return top.withColumn("weight", F.col("n") / F.max("n").over(
        Window.partitionBy(F.lit(0))))  # at most max_words rows


def corpus_overview(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.agg(F.count("*").alias("documents"),
                    F.sum(F.length(text)).cast("long").alias("total_chars"))


def history_page(history: DataFrame, kind: str | None, limit: int, offset: int = 0) -> DataFrame:
    """(id, kind, created_at) newest first."""
    rows = history if kind is None else history.where(F.col("kind") == kind)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def history_stats(history: DataFrame) -> DataFrame:
    return history.groupBy("kind").agg(F.count("*").alias("analyses"))


def document_search(docs: DataFrame, needle: str) -> DataFrame:
    """(path, name, created_at): the keyword in the name or the path."""
    n = needle.lower()
    hit = F.lower("name").contains(n) | F.lower("path").contains(n)
    return docs.where(hit).orderBy(F.desc("created_at"), F.asc("path"))


def corpus_word_frequency(docs: DataFrame, stop: DataFrame | None, top_n: int,
                          min_length: int = 2, text: str = "text") -> DataFrame:
    """Counted straight per term: no per-document shuffle; TakeOrdered at the end."""
    terms = explode_terms(docs, [], tx.words_en(F.col(text)))
    if stop is not None:
        terms = drop_stopwords(terms, stop)
    return (terms.where(F.length("term") >= min_length).groupBy("term")
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("term")).limit(top_n))
