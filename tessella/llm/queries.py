"""The registered queries of this subpackage: name → (spark, folder) → rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Query]:
    from tessella.llm import ball_tree, bpe, hard_negatives, html_text, jaccard_join, lang_kernel, line_dedup, merkle, mixing, multiset, pseudonyms, secret_scan, vector_join

    return {
        "op1_secret_scan": lambda s, d: secret_scan.digest(secret_scan.scan(read(s, d, "documents"))),
        "op2_source_mix": lambda s, d: mixing.report(mixing.mix(read(s, d, "documents"))),
        "op6_line_dedup": lambda s, d: line_dedup.report(read(s, d, "documents")),
        "op7_multiset_hash": lambda s, d: multiset.compare_edits(read(s, d, "documents")),
        "op8_ngram_jaccard": lambda s, d: jaccard_join.join(read(s, d, "documents")),
        "op3_pii_pseudonyms": lambda s, d: pseudonyms.report(read(s, d, "documents")),
        "op4_html_text": lambda s, d: html_text.extract(read(s, d, "pages")),
        "op5_byte_bpe": lambda s, d: bpe.digest(read(s, d, "documents")),
        "op9_embedding_dedup": lambda s, d: vector_join.join(read(s, d, "embeddings")),
        "op10_language_id": lambda s, d: lang_kernel.report(read(s, d, "documents")),
        "op11_merkle_manifest": lambda s, d: merkle.report(read(s, d, "documents")),
        "op12_hard_negatives": lambda s, d: hard_negatives.report(read(s, d, "embeddings")),
        "op13_top_k_search": lambda s, d: ball_tree.report(read(s, d, "embeddings")),
    }


def oracles() -> dict[str, str]:
    from tessella.llm import ball_tree, hard_negatives, merkle

    return {"op11_merkle_manifest": merkle.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE,
            "op13_top_k_search": ball_tree.ORACLE}
