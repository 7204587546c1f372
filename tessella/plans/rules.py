"""Rule matching, action plans, collisions, logs and undo."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import files as fx
from tessella.operators import inventory as inv
from tessella.operators import rules as rl
from tessella.plans import contracts as c
from tessella.plans.inventory import CAT, NAMING, STEM, _files
from tessella.plans.registry import query
from tessella.plans.sqlparts import word_list
from tessella.sources.tables import table

AS_OF = "2024-01-30 00:00:00"

# (id, name, priority, enabled, logic, conditions (type, value, negate), actions), and the SQL of its match
BOOK = [
    (1, "images", 10, True, "AND", [("extension", "jpg, PNG", False)],
     [{"type": "move", "target_dir": "Images/{modified_year}-{modified_month}", "new_name": ""},
      {"type": "rename", "new_name": "{name}_{size}.{ext}"}, {"type": "copy", "target_dir": "/backup/{created}"}],
     "extension IN ('jpg', 'png')"),
    (2, "large reports", 20, True, "AND", [("filename_keyword", "report,README", False), ("file_size_min", "50KB", False)],
     [{"type": "backup", "backup_dir": "bak"}, {"type": "zip"}],
     "(lower(name) LIKE '%report%' OR lower(name) LIKE '%readme%') AND size >= 51200"),
    (3, "not old code", 5, True, "NOT", [("file_type", "code", False), ("date_modified_to", "2023-12-01", False)],
     [{"type": "shred"}],
     f"NOT (extension IN ({word_list('py js ts java c cpp h hpp cs go rb php html css json xml yaml yml sql sh bat'.split())}) AND modified_time <= TIMESTAMP '2023-12-01')"),
    (4, "dated or audio", 15, True, "OR", [("regex", r"^\d{4}-", False), ("file_type", "Music", False)],
     [{"type": "copy", "target_dir": "{extension}", "new_name": "{filename}"}],
     "regexp_matches(name, '^\\d{4}-') OR extension IN ('mp3')"),
    (5, "recent but not documents", 8, True, "AND", [("date_created_from", "60d", False), ("file_type", "document", True), ("file_size_max", "0.5 mb", False)],
     [{"type": "move", "target_dir": "Recent"}],
     "created_time >= TIMESTAMP '2024-01-30' - to_days(60) AND extension NOT IN ('txt', 'md', 'pdf') AND size <= 524288"),
    (6, "switched off", 99, False, "AND", [("extension", "py", False)], [{"type": "move", "target_dir": "off"}], "extension = 'py'"),
    (7, "unsupported", 50, True, "AND", [("contains_text", "secret", False)], [{"type": "move", "target_dir": "x"}], "FALSE"),
    (8, "broken value", 50, True, "AND", [("file_size_min", "many", False)], [{"type": "move", "target_dir": "x"}], "FALSE"),
    (9, "everything else", 0, True, "AND", [], [{"type": "move", "target_dir": "Other"}], "TRUE"),
]


def _rules(*ids):
    return [rl.Rule(i, n, p, e, lo, [{"type": t, "value": v, "negate": g} for t, v, g in cs], a)
            for i, n, p, e, lo, cs, a, _ in BOOK if not ids or i in ids]


ALL_MATCHES = "m AS (" + " UNION ALL ".join(
    f"SELECT *, {i} AS rule_id, {p} AS priority FROM files WHERE {s}" for i, _, p, e, _, _, _, s in BOOK if e) + ")"
FIRST = f"{c.FILES_SQL}, {ALL_MATCHES}, best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY priority DESC, rule_id) = 1)"


@query("rule_match", f"""WITH {c.FILES_SQL} """ + " UNION ALL ".join(
    f"SELECT path, {i} AS rule_id, {s} AS matched FROM files" for i, _, _, _, _, _, _, s in BOOK))
def rule_match(spark, d):
    flags = F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule_id"), rl.predicate(r, AS_OF).alias("matched"))
                                for r in _rules()]))
    return _files(spark, d).select("path", flags.alias("m")).select("path", "m.*")


@query("rule_match_first", f"WITH {FIRST} SELECT path, rule_id FROM best")
def rule_match_first(spark, d):
    return rl.match_first(_files(spark, d), _rules(), AS_OF).select("path", "rule_id")


@query("rule_match_all", f"WITH {c.FILES_SQL}, {ALL_MATCHES} SELECT path, rule_id, priority FROM m")
def rule_match_all(spark, d):
    return rl.match_all(_files(spark, d), _rules(), AS_OF)


@query("rule_test", f"WITH {c.FILES_SQL} SELECT path, size, ({BOOK[3][7]}) AS matched FROM files")
def rule_test(spark, d):
    return rl.rule_test(_files(spark, d), _rules(4)[0], AS_OF).select("path", "size", "matched")


SIZE_TEXT = "concat(n_chars % 1000, CASE doc_id % 7 WHEN 0 THEN 'KB' WHEN 1 THEN ' mb' WHEN 2 THEN 'B' WHEN 3 THEN '.5 GB' WHEN 4 THEN ' files' WHEN 5 THEN '' ELSE '.25kb ' END)"


@query("parse_size", f"""WITH t AS (SELECT doc_id, {SIZE_TEXT} AS raw FROM documents), u AS (SELECT *, upper(trim(raw)) AS s FROM t)
SELECT doc_id, raw, CAST(trunc(TRY_CAST(trim(regexp_replace(s, '(KB|MB|GB|B)$', '')) AS DOUBLE) * CASE WHEN s LIKE '%KB' THEN 1024
  WHEN s LIKE '%MB' THEN 1048576 WHEN s LIKE '%GB' THEN 1073741824 ELSE 1 END) AS BIGINT) AS bytes FROM u""")
def parse_size(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(SIZE_TEXT).alias("raw")).withColumn(
        "bytes", fx.parse_size(F.col("raw")))


WHEN_TEXT = ("CASE doc_id % 7 WHEN 0 THEN concat('2024-1-', 1 + doc_id % 28) WHEN 1 THEN concat('2023/12/', 10 + doc_id % 19, ' 08:05:09') "
             "WHEN 2 THEN concat(doc_id % 90, 'd') WHEN 3 THEN 'yesterday' WHEN 4 THEN concat('2024-02-', 10 + doc_id % 30) "
             "WHEN 5 THEN '2023-06-01 12:30' ELSE concat(' 2023-06-0', 1 + doc_id % 9, ' 23:59:58 ') END")


@query("parse_when", f"""WITH t AS (SELECT doc_id, {WHEN_TEXT} AS raw FROM documents)
SELECT doc_id, raw, strftime(coalesce(try_strptime(trim(raw), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%Y/%m/%d %H:%M:%S', '%Y/%m/%d']),
  TIMESTAMP '2024-01-30' - to_days(TRY_CAST(regexp_extract(trim(raw), '^(\\d+)[dD]$', 1) AS INTEGER))), '%Y-%m-%d %H:%M:%S') AS moment FROM t""")
def parse_when(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(WHEN_TEXT).alias("raw")).withColumn(
        "moment", F.date_format(fx.parse_when(F.col("raw"), AS_OF), "yyyy-MM-dd HH:mm:ss"))


STAMP = "20240130_000000"
PLAN = f"""{FIRST},
s AS (SELECT *, {STEM} AS stem, regexp_replace(path, '/[^/]*$', '') AS dir FROM best),
one AS (SELECT *, parent || '/Images/' || strftime(modified_time, '%Y-%m') AS d1 FROM s WHERE rule_id = 1),
plan AS (SELECT path, rule_id, 1 AS step, 'move' AS action, path AS source, d1 || '/' || name AS target FROM one
UNION ALL SELECT path, 1, 2, 'rename', d1 || '/' || name, d1 || '/' || stem || '_' || size || '.' || extension FROM one
UNION ALL SELECT path, 1, 3, 'copy', d1 || '/' || stem || '_' || size || '.' || extension, '/backup/' || strftime(created_time, '%Y%m%d') || '/' || stem || '_' || size || '.' || extension FROM one
UNION ALL SELECT path, 2, 1, 'backup', path, parent || '/bak/{STAMP}_' || name FROM s WHERE rule_id = 2
UNION ALL SELECT path, 2, 2, 'zip', path, parent || '/' || stem || '.zip' FROM s WHERE rule_id = 2
UNION ALL SELECT path, 3, 1, 'shred', path, NULL FROM s WHERE rule_id = 3
UNION ALL SELECT path, 4, 1, 'copy', path, parent || '/' || extension || '/' || name FROM s WHERE rule_id = 4
UNION ALL SELECT path, 5, 1, 'move', path, parent || '/Recent/' || name FROM s WHERE rule_id = 5
UNION ALL SELECT path, 9, 1, 'move', path, parent || '/Other/' || name FROM s WHERE rule_id = 9)"""


def _plan(spark, d):
    return rl.action_plan(_files(spark, d), _rules(), AS_OF, STAMP)


@query("action_plan", f"WITH {PLAN} SELECT *, CASE action WHEN 'shred' THEN 'failed' ELSE 'success' END AS status FROM plan")
def action_plan(spark, d):
    return _plan(spark, d)


@query("run_summary", f"""WITH {PLAN} SELECT (SELECT count(*) FROM files) AS total_files, count(DISTINCT path) AS matched, count(*) AS operations,
count(*) FILTER (action <> 'shred') AS succeeded, count(*) FILTER (action = 'shred') AS failed FROM plan""")
def run_summary(spark, d):
    return rl.run_summary(_files(spark, d), _plan(spark, d))


TARGET = "'/out/' || category || '/' || naming || '.bin'"


@query("target_collisions", f"""WITH {c.FILES_SQL}, f AS (SELECT *, {CAT} AS category, {NAMING} AS naming FROM files),
mv AS (SELECT path AS source, {TARGET} AS target, parent FROM f),
ex AS (SELECT DISTINCT p FROM (SELECT '/out/code/camelCase(' || (page_id * 3 % 40) || ').bin' AS p FROM pages UNION ALL SELECT '/out/image/PascalCase.bin')),
tk AS (SELECT p AS target, 0 AS t FROM ex UNION SELECT regexp_extract(p, '^(.*)\\((\\d+)\\)(\\.[^./]*)?$', 1) || '.bin', regexp_extract(p, '^(.*)\\((\\d+)\\)(\\.[^./]*)?$', 2)::INTEGER FROM ex WHERE p LIKE '%(%'),
rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY parent, source) AS r FROM mv),
free AS (SELECT target, n, row_number() OVER (PARTITION BY target ORDER BY n) AS r
  FROM (SELECT DISTINCT target FROM mv), range(1500) x(n) WHERE (target || n) NOT IN (SELECT target || t FROM tk))
SELECT source, target, CASE WHEN n = 0 THEN target ELSE replace(target, '.bin', '(' || n || ').bin') END AS final_target
FROM rk JOIN free USING (target, r)""")
def target_collisions(spark, d):
    moves = inv.described(_files(spark, d)).select(
        F.col("path").alias("source"),
        F.concat(F.lit("/out/"), "category", F.lit("/"), "naming", F.lit(".bin")).alias("target"))
    existing = table(spark, d, "pages").select(F.concat(
        F.lit("/out/code/camelCase("), F.col("page_id") * 3 % 40, F.lit(").bin")).alias("path")).distinct()
    existing = existing.unionByName(existing.limit(1).select(F.lit("/out/image/PascalCase.bin").alias("path")))
    return rl.target_collisions(moves, existing)


LOG = """log AS (SELECT o_orderkey AS id, 'b' || (o_custkey % 50) AS batch_id, CASE o_orderkey % 6 WHEN 0 THEN 'move' WHEN 1 THEN 'copy' WHEN 2 THEN 'rename'
  WHEN 3 THEN 'zip' WHEN 4 THEN 'backup' ELSE 'unzip' END AS operation_type, '/in/' || o_orderkey AS source_path, '/out/' || o_orderkey AS target_path,
  CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status, o_orderdate AS executed_at FROM orders)"""


def _log(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("b"), F.col("o_custkey") % 50).alias("batch_id"),
        F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'move' WHEN 1 THEN 'copy' WHEN 2 THEN 'rename' WHEN 3 THEN 'zip' "
               "WHEN 4 THEN 'backup' ELSE 'unzip' END").alias("operation_type"),
        F.concat(F.lit("/in/"), "o_orderkey").alias("source_path"), F.concat(F.lit("/out/"), "o_orderkey").alias("target_path"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("status"),
        F.col("o_orderdate").alias("executed_at"))


@query("operation_log", f"WITH {LOG} SELECT id, batch_id, operation_type, status FROM log ORDER BY executed_at DESC, id DESC LIMIT 100")
def operation_log(spark, d):
    return rl.log_page(_log(spark, d), 100).select("id", "batch_id", "operation_type", "status")


@query("last_batch", f"WITH {LOG} SELECT batch_id FROM log ORDER BY executed_at DESC, id DESC LIMIT 1")
def last_batch(spark, d):
    return rl.last_batch(_log(spark, d))


@query("undo_plan", f"""WITH {LOG} SELECT batch_id, id, 'undo_' || operation_type AS operation_type, target_path AS source_path, source_path AS target_path,
CASE WHEN operation_type = 'unzip' THEN 'skipped' ELSE 'planned' END AS status FROM log WHERE status = 'success'
AND batch_id = (SELECT batch_id FROM log ORDER BY executed_at DESC, id DESC LIMIT 1)""")
def undo_plan(spark, d):
    log = _log(spark, d)
    return rl.undo_plan(log, rl.last_batch(log))


@query("rule_bundle", """WITH r AS (SELECT n_nationkey AS rule_id, n_name AS name, n_regionkey AS priority FROM nation WHERE n_nationkey % 4 <> 0),
p AS (SELECT p_partkey % 25 AS rule_id, 'condition' AS part, row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_size, p_partkey) AS position, p_type AS kind, p_name AS value FROM part
UNION ALL SELECT s_suppkey % 25, 'action', row_number() OVER (PARTITION BY s_suppkey % 25 ORDER BY s_suppkey), 'move', s_name FROM supplier)
SELECT * FROM r LEFT JOIN p USING (rule_id)""")
def rule_bundle(spark, d):
    rules = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("priority"), (F.col("n_nationkey") % 4 != 0).alias("enabled"))
    conditions = table(spark, d, "part").select(
        (F.col("p_partkey") % 25).alias("rule_id"), F.col("p_partkey").alias("part_id"), F.col("p_size").alias("sort_order"),
        F.col("p_type").alias("condition_type"), F.col("p_name").alias("condition_value"))
    actions = table(spark, d, "supplier").select(
        (F.col("s_suppkey") % 25).alias("rule_id"), F.col("s_suppkey").alias("part_id"), F.col("s_suppkey").alias("sort_order"),
        F.lit("move").alias("action_type"), F.col("s_name").alias("action_params"))
    return rl.rule_bundle(rules, conditions, actions)


def _template_sql():
    parts = []
    for name, make in rl.TEMPLATES.items():
        for r in rl.ordered(make()):
            wheres = []
            for k in r.conditions:
                if k["type"] == "extension":
                    wheres.append(f"extension IN ({word_list(k['value'].split(','))})")
                elif k["type"] == "file_type":
                    wheres.append("extension IN ('jpg')" if k["value"] == "image" else "extension IN ('mp3')")
                else:
                    wheres.append("modified_time <= TIMESTAMP '2024-01-30' - to_days(30)")
            parts.append(f"SELECT '{name}' AS template, {r.id} AS rule_id, '{r.name}' AS rule, count(*) AS files FROM files WHERE {' AND '.join(wheres) or 'TRUE'}")
    return f"WITH {c.FILES_SQL} " + " UNION ALL ".join(parts)


@query("rule_templates", _template_sql())
def rule_templates(spark, d):
    """How many files each template rule would match, in one aggregation."""
    rules = [(t, r) for t, make in rl.TEMPLATES.items() for r in rl.ordered(make())]
    wide = _files(spark, d).agg(*[F.count_if(rl.predicate(r, AS_OF)).alias(f"c{i}") for i, (_, r) in enumerate(rules)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("template"), F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule"), F.col(f"c{i}").alias("files"))
        for i, (t, r) in enumerate(rules)])).alias("x")).select("x.*")
