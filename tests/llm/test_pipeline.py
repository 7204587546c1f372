import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline as C
import __spark_entry__ as entry
from tessella.llm import bpe, jaccard_join, line_dedup, mixing
import public_tokenizers as P


def test_stages_on_each_others_output(spark):
    """Every stage against what its operator says about its own input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    known = C.language_id(spark, docs, "").collect()
    assert {r.doc_id for r in known} == set(before)  # all of them have letters
    lines = spark.createDataFrame(known, docs.schema)
    deduped = C.line_deduplication(spark, lines, "").collect()
    left = {r.doc_id: r.text for r in line_dedup.report(lines).collect()}
    assert {r.doc_id: r.text for r in deduped} == {i: t for i, t in left.items() if t.strip(" \t\n\r\x0b\x0c")}
    assert all(r.n_chars == len(r.text) for r in deduped)
    groups = spark.createDataFrame(deduped, docs.schema)
    single = C.near_duplicates(spark, groups, "").collect()
    assert sorted(r.doc_id for r in single) == sorted({r.component_id for r in jaccard_join.join(groups).collect()})
    sources = spark.createDataFrame(single, docs.schema)
    mixed = C.source_mix(spark, sources, "").collect()
    plan = mixing.report(mixing.mix(sources)).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in plan)
    assert mixed[0].__fields__ == docs.columns
    last = C.token_ids(spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    encoder = bpe.Encoder(bpe.RANKS, P.PATTERN)
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), len(encoder.encode([r.text])[0])) for r in mixed)
    assert sorted((r.doc_id, r.decoded_sha256, r.n_tokens) for r in last) == want
    assert sorted((r.doc_id, r.ids_sha256) for r in C.run(spark, "/root/testdata/sf0.001").collect()) == sorted(
        (r.doc_id, r.ids_sha256) for r in last)


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in C.STAGES:
            docs = stage(spark, docs, "")
            docs.write.format("noop").mode("overwrite").save()


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


def test_texts_in_no_known_language_go(spark):
    """Foreign scripts, languages without a label and random letters, between clean rows."""
    rng = random.Random(4)
    latin = "abcdefghijklmnopqrstuvwxyz"
    noise = [
        "Этот текст написан на русском языке и рассказывает об истории города и его жителях.",
        "Αυτό το κείμενο είναι γραμμένο στα ελληνικά και μιλά για την ιστορία της πόλης.",
        "这是一段用中文写成的文字，讲述了这座城市的历史以及居民的生活。", "日本語の短い文です。", "1234567890 " * 50 + "中文",
        "Tämä on suomenkielinen teksti, jossa kerrotaan kaupungin historiasta ja sen asukkaiden elämästä vuosisatojen aikana. "
        "Joki virtaa keskustan läpi, ja sen rannalla on vanhoja puutaloja, joissa asuu yhä perheitä.",
        "Questo testo parla della storia della città e degli abitanti che vi hanno vissuto per molti secoli con orgoglio. "
        "Il fiume attraversa il centro, e sulle sue rive ci sono vecchie case di legno dove vivono ancora famiglie.",
        "Ten tekst opowiada o historii miasta i jego mieszkańców, którzy żyli tam przez wiele wieków z wielką dumą.",
        *[" ".join("".join(rng.choices(latin, k=rng.randint(2, 10))) for _ in range(40)) for _ in range(30)],
        "".join(rng.choices(latin, k=300)),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(10**9 + k, t, None, "web", len(t)) for k, t in enumerate(noise)]
    added = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(added)
    kept = {r.doc_id for r in C.language_id(spark, both, "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
