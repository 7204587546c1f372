"""Readers and writers: each writes derived rows and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import inventory as inv
from tessella.plans import contracts as c
from tessella.plans import inventory as pi
from tessella.plans.habits import _scratch
from tessella.plans.registry import query
from tessella.sources import exports, files
from tessella.sources.tables import table


PER_FILE = 25  # texts of a file
CLEAN = "regexp_replace(text, '[^ -~]', '', 'g')"
FILES = f"""t AS (SELECT item_id // {PER_FILE} AS f, string_agg({CLEAN} || '北京', chr(10) ORDER BY item_id) AS content FROM benchmark GROUP BY ALL)"""


def _corpus(spark, d):
    """Files of several texts each: every other one in GBK, every third one's last byte cut off."""
    path = _scratch(spark, "corpus")
    texts = table(spark, d, "benchmark").select(
        F.expr(f"item_id div {PER_FILE}").alias("f"), "item_id", F.concat(F.regexp_replace("text", "[^ -~]", ""), F.lit("北京")).alias("text"))
    rows = texts.groupBy("f").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: x.text), "\n").alias("text"))
    raw = F.when(F.col("f") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "GBK"))
    whole = rows.select(F.concat(F.lit("part-"), "f", F.when(F.col("f") % 3 == 0, ".txt").otherwise(".TXT")).alias("name"),
                        raw.alias("content"), F.lit(None).cast("string").alias("encoding"))
    broken = rows.select(F.concat(F.lit("sub/broken-"), "f", F.lit(".txt")).alias("name"),
                         F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FFFF"))).alias("content"), F.lit(None).cast("string").alias("encoding"))
    other = rows.select(F.concat(F.lit("notes-"), "f", F.lit(".md")).alias("name"), raw.alias("content"), F.lit(None).cast("string").alias("encoding"))
    files.write_files(whole.unionByName(broken).unionByName(other), path)
    return path


@query("corpus_scan", f"""WITH {FILES} SELECT 'part-' || f || CASE f % 3 WHEN 0 THEN '.txt' ELSE '.TXT' END AS name, md5(content) AS content,
CASE f % 2 WHEN 0 THEN 'utf-8' ELSE 'gbk' END AS encoding, NULL AS error FROM t
UNION ALL SELECT 'broken-' || f || '.txt', NULL, NULL, 'neither utf-8 nor gbk' FROM t
UNION ALL SELECT 'gone-' || f || '.txt', NULL, NULL, 'FileNotFoundError' FROM t""")
def corpus_scan(spark, d):
    """Whole, broken and missing files; names that are on a list but in no folder are missing."""
    path = _corpus(spark, d)
    columns = ("name", F.md5("content").alias("content"), "encoding", "error")
    found = files.corpus(spark, path=path, extension="TXT").select(*columns)
    listed = table(spark, d, "benchmark").select(F.expr(f"item_id div {PER_FILE}").alias("f")).distinct().collect()
    gone = files.corpus(spark, paths="\n".join(f"{path}/gone-{r['f']}.txt" for r in listed)).select(*columns)
    return found.unionByName(gone)


@query("folder_inventory", f"""WITH {FILES}, n AS (SELECT f, strlen(content) + (CASE f % 2 WHEN 0 THEN 0 ELSE -1 END) * 2 * (len(content) - len(replace(content, '北京', '')))/ 2 AS size, strlen(content) + 2 AS broken FROM t)
SELECT 'part-' || f AS stem, 'txt' AS extension, size::BIGINT AS size, 1 AS depth FROM n
UNION ALL SELECT 'notes-' || f, 'md', size::BIGINT, 1 FROM n UNION ALL SELECT 'broken-' || f, 'txt', broken::BIGINT, 2 FROM n""")
def folder_inventory(spark, d):
    rows = files.file_inventory(spark, _corpus(spark, d))
    return rows.select(F.regexp_extract("name", "^([^.]*)", 1).alias("stem"), "extension", "size", "depth")


@query("decode_with_fallback", """SELECT doc_id, md5(regexp_replace(text, '[^ -~]', '', 'g') || '北京') AS decoded FROM documents""")
def decode_with_fallback(spark, d):
    clean = F.concat(F.regexp_replace("text", "[^ -~]", ""), F.lit("北京"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(clean, "UTF-8")).otherwise(F.encode(clean, "GBK"))
    return table(spark, d, "documents").select("doc_id", F.md5(files.decode_with_fallback(raw)).alias("decoded"))


@query("history_append", """SELECT o_orderpriority AS kind, count(*) AS records, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def history_append(spark, d):
    path = _scratch(spark, "history")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("created_at"),
        F.struct(F.col("o_custkey").alias("customer")).alias("parameters"),
        F.struct(F.col("o_totalprice").alias("price")).alias("results"))
    for part in (0, 1):
        exports.append_history(rows.where(F.col("id") % 2 == part), path)
    price = F.get_json_object("results", "$.price").cast("decimal(20,2)")
    return spark.read.parquet(path).groupBy("kind").agg(
        F.count("*").alias("records"), F.sum(price).cast("double").alias("total"))


@query("document_upsert", """SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'zh' ELSE lang END AS language,
CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS word_count FROM documents
UNION ALL SELECT 'new/' || page_id, 'html', length(html) FROM pages""")
def document_upsert(spark, d):
    docs = table(spark, d, "documents").select(
        F.concat_ws("/", "source", "doc_id").alias("path"), F.col("lang").alias("language"),
        F.col("n_chars").alias("word_count"), F.lit(1).alias("updated_at"), "doc_id")
    newer = docs.where("doc_id % 3 = 0").withColumns({
        "language": F.lit("zh"), "word_count": F.col("word_count") + 1, "updated_at": F.lit(2)}).drop("doc_id")
    added = table(spark, d, "pages").select(
        F.concat(F.lit("new/"), "page_id").alias("path"), F.lit("html").alias("language"),
        F.length("html").cast("long").alias("word_count"), F.lit(1).alias("updated_at"))
    return exports.upsert_documents(docs.drop("doc_id"), newer.unionByName(added)).drop("updated_at")


def _records(name, sql):
    return f"SELECT '{name}' AS section, count(*) AS records FROM ({sql})"


@query("report_export", f"""WITH {pi.RECOMMENDED}, {pi.DIST}, {pi.LAYOUT}
{_records('rules', pi.SUGGESTED)} UNION ALL {_records('recommendations', 'SELECT * FROM recs')}
UNION ALL {_records('structure', 'SELECT * FROM layout WHERE target IS NOT NULL AND source <> target')}
UNION ALL {_records('naming', 'SELECT * FROM nc')} UNION ALL {_records('modules', 'SELECT * FROM mods')}
UNION ALL {_records('statistics', 'SELECT * FROM dist')}""")
def report_export(spark, d):
    """All sections, written and read again."""
    rows = c.files(spark, d).drop("n", "up", "text")
    path = _scratch(spark, "report")
    edges, code = pi._edges(spark, d), pi._code(spark, d)
    sections = {"rules": inv.suggested_rules(rows, spark), "recommendations": inv.recommendations(rows, edges, c.FILE_ROOT),
                "structure": inv.target_layout(rows, c.FILE_ROOT), "naming": inv.naming_consistency(code),
                "modules": inv.module_cohesion(edges, code), "statistics": inv.distributions(rows)}
    out = None
    for name in exports.report(sections, path):
        n = spark.read.text(f"{path}/{name}").agg(F.count("*").alias("records")).select(
            F.lit(name).alias("section"), "records")
        out = n if out is None else out.unionByName(n)
    return out
