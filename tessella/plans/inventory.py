"""File-inventory queries; the files are derived from documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.data import filetypes as ft
from tessella.functions import files as fx
from tessella.operators import inventory as inv
from tessella.plans import contracts as c
from tessella.plans.habits import _scratch
from tessella.plans.registry import query
from tessella.plans.sqlparts import values, word_list
from tessella.sources import snapshots
from tessella.sources.tables import table

ROOT = c.FILE_ROOT
CAT = "CASE " + " ".join(f"WHEN extension IN ({word_list(e.split())}) THEN '{k}'"
                         for k, e in ft.CATEGORIES.items()) + " ELSE 'other' END"
BUCKET = "CASE " + " ".join(f"WHEN size < {n} THEN '{s}'" for n, s in ft.SIZE_BUCKETS) + f" ELSE '{ft.LARGEST_BUCKET}' END"
STEM = f"regexp_extract(name, '{fx.SPLIT_NAME}', 1)"
NAMING = ("CASE " + " ".join(f"WHEN regexp_matches({STEM}, '{p}') THEN '{s}'" for s, p in ft.NAMING)
          + f" WHEN regexp_matches(lower({STEM}), '{'|'.join(ft.TEST_HINTS)}') THEN 'test_file'"
          + f" WHEN regexp_matches(lower({STEM}), '^({'|'.join(ft.DOC_HINTS)})') THEN 'project_doc'"
          + f" WHEN regexp_matches(lower({STEM}), '^(dockerfile|makefile|\\.env)') THEN 'build_config' ELSE 'mixed' END")
DESC = f"{c.FILES_SQL}, f AS (SELECT *, {CAT} AS category, {BUCKET} AS bucket, {NAMING} AS naming FROM files)"
W = f"WITH {DESC}"


def _files(spark, d):
    return c.files(spark, d).drop("n", "up", "text")


def _code(spark, d):
    return inv.described(_files(spark, d)).where("category = 'code'")


@query("file_inventory", f"""WITH {c.FILES_SQL} SELECT path, name, extension, size,
strftime(modified_time, '%Y-%m-%d %H:%M') AS modified, parent, depth FROM files""")
def file_inventory(spark, d):
    return _files(spark, d).select("path", "name", "extension", "size", F.date_format(
        "modified_time", "yyyy-MM-dd HH:mm").alias("modified"), "parent", F.col("depth").cast("long"))


@query("file_size_label", f"""WITH {c.FILES_SQL}, s AS (SELECT path, size, CASE WHEN size < 1024 THEN 0
 WHEN size < 1048576 THEN 1024 WHEN size < 1073741824 THEN 1048576 ELSE 1073741824 END AS u FROM files),
h AS (SELECT *, CASE WHEN u > 0 THEN round(size * 100.0::DOUBLE / u)::BIGINT END AS h FROM s)
SELECT path, CASE u WHEN 0 THEN size || ' B' ELSE (h // 100) || '.' || lpad((h % 100)::VARCHAR, 2, '0') ||
CASE u WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS label FROM h""")
def file_size_label(spark, d):
    return _files(spark, d).select("path", fx.size_label(F.col("size")).alias("label"))


@query("file_category", f"{W} SELECT path, category FROM f")
def file_category(spark, d):
    return inv.described(_files(spark, d)).select("path", "category")


@query("size_bucket", f"{W} SELECT path, bucket AS size_bucket FROM f")
def size_bucket(spark, d):
    return inv.described(_files(spark, d)).select("path", "size_bucket")


@query("naming_pattern", f"{W} SELECT path, naming FROM f")
def naming_pattern(spark, d):
    return inv.described(_files(spark, d)).select("path", "naming")


MARKED = """CASE doc_id % 17 WHEN 0 THEN '/x/.git/' WHEN 1 THEN '/x/distribution/' WHEN 2 THEN '/x/venv2/'
  WHEN 3 THEN '/x/src/.' WHEN 4 THEN '/x/old_targets/' WHEN 5 THEN '/x/a.pyc' ELSE '/x/lib/' END"""


@query("ignore_filter", f"""WITH m AS (SELECT doc_id, {MARKED} || source || '.txt' AS path FROM documents),
n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM m)
SELECT doc_id, path FROM n WHERE NOT (name LIKE '.%' OR regexp_matches(path, '{"|".join(ft.IGNORED)}'))""")
def ignore_filter(spark, d):
    rows = table(spark, d, "documents").select(
        "doc_id", F.concat(F.expr(MARKED), "source", F.lit(".txt")).alias("path"))
    return inv.keep_scanned(rows.withColumn("name", fx.base_name(F.col("path")))).select("doc_id", "path")


def _imp(family, group="1"):
    exts, pattern = ft.IMPORTS[family]
    got = f"regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"
    if family == "go":
        got = f"list_filter({got}, lambda s: regexp_matches(s, '^[^/]*\\.[^/]*/'))"
    return f"WHEN extension IN ({word_list(exts.split())}) THEN {got}"


IMPORTS = f"""{DESC}, {c.TEXTS_SQL},
imp AS (SELECT DISTINCT path, unnest(CASE {' '.join(_imp(k) for k in ft.IMPORTS)} END) AS import FROM texts)"""


@query("source_imports", f"WITH {IMPORTS} SELECT path, import FROM imp")
def source_imports(spark, d):
    return inv.source_imports(c.source_texts(spark, d))


NORMAL = """'/' || array_to_string(list_reduce(list_transform(list_filter(string_split(raw, '/'), lambda s: s <> '' AND s <> '.'), lambda s: [s]),
  lambda acc, s: CASE WHEN s[1] = '..' THEN list_slice(acc, 1, len(acc) - 1) ELSE list_concat(acc, s) END), '/')"""
DIR = "regexp_replace({x}, '/[^/]*$', '')"
EDGES = f"""{IMPORTS}, raw AS (SELECT path AS src, CASE WHEN import LIKE '/%' THEN import ELSE {DIR.format(x='path')} || '/' || import END AS raw FROM imp),
code AS (SELECT * FROM f WHERE category = 'code'),
edges AS (SELECT src, dst FROM (SELECT src, {NORMAL} AS dst FROM raw) WHERE dst IN (SELECT path FROM code)),
el AS (SELECT *, {DIR.format(x='src')} AS sd, {DIR.format(x='dst')} AS dd FROM edges),
mods AS (SELECT parent AS directory, count(*) AS files, (SELECT count(*) FROM el WHERE sd = parent AND dd = parent) AS internal,
  (SELECT count(*) FROM el WHERE sd = parent AND dd <> parent) AS external FROM code GROUP BY parent
  HAVING count(*) >= 2 AND (SELECT count(*) FROM code) >= 3)"""


def _edges(spark, d):
    return inv.dependency_edges(inv.source_imports(c.source_texts(spark, d)), _code(spark, d))


@query("dependency_edges", f"WITH {EDGES} SELECT src, dst FROM edges")
def dependency_edges(spark, d):
    return _edges(spark, d)


@query("dependency_hotspots", f"""WITH {EDGES} SELECT dst, count(*) AS dependents FROM edges GROUP BY ALL
HAVING count(*) >= 3 ORDER BY dependents DESC, dst LIMIT 5""")
def dependency_hotspots(spark, d):
    return inv.hotspots(_edges(spark, d))


@query("module_clusters", f"""WITH {EDGES} SELECT parent AS directory, path FROM code
WHERE parent IN (SELECT directory FROM mods WHERE internal >= files)""")
def module_clusters(spark, d):
    return inv.module_clusters(_edges(spark, d), _code(spark, d))


@query("module_cohesion", f"""WITH {EDGES} SELECT directory, files, internal, external,
round(internal::DOUBLE / greatest(internal + external, 1), 6) AS cohesion, internal >= files AS is_module FROM mods""")
def module_cohesion(spark, d):
    return inv.module_cohesion(_edges(spark, d), _code(spark, d)).withColumn("cohesion", F.round("cohesion", 6))


@query("file_signature", f"""WITH {c.FILES_SQL} SELECT path,
md5(path || '|' || size || '|' || epoch(modified_time)::BIGINT) AS signature FROM files""")
def file_signature(spark, d):
    return inv.signatures(_files(spark, d)).select("path", "signature")


DIRS = f"""pd AS (SELECT DISTINCT parent FROM files WHERE parent <> '{ROOT}'),
dirs AS (SELECT DISTINCT array_to_string(list_slice(string_split(parent, '/'), 1, i), '/') AS directory
  FROM (SELECT parent, unnest(range(3, len(string_split(parent, '/')) + 1)) AS i FROM pd)),
st AS (SELECT count(*) AS files, (SELECT count(*) FROM dirs) AS dirs, sum(size)::BIGINT AS bytes, max(depth) AS max_depth,
  count(*)::DOUBLE / greatest((SELECT count(*) FROM dirs), 1) AS avg_files FROM files)"""


@query("directory_stats", f"""WITH {c.FILES_SQL}, {DIRS} SELECT files, dirs, bytes, max_depth,
round(avg_files, 6) AS avg_files_per_dir FROM st""")
def directory_stats(spark, d):
    return inv.directory_stats(_files(spark, d), ROOT).withColumn(
        "avg_files_per_dir", F.round("avg_files_per_dir", 6))


DIST = """dist AS (SELECT 'by_extension' AS metric, extension AS key, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT 'by_category', category, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'by_size', bucket, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'by_depth', depth::VARCHAR, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'by_naming', naming, count(*) FROM f GROUP BY ALL)"""


@query("file_distributions", f"""{W}, {DIST} SELECT * FROM dist WHERE metric <> 'by_extension' UNION ALL
SELECT * FROM (SELECT * FROM dist WHERE metric = 'by_extension' ORDER BY n DESC, key LIMIT 10)""")
def file_distributions(spark, d):
    return inv.report_distributions(_files(spark, d), 10)


NCONS = """np AS (SELECT naming, count(*) AS n FROM f WHERE category = 'code' AND extension <> '' GROUP BY ALL),
nc AS (SELECT (SELECT naming FROM np ORDER BY n DESC, naming LIMIT 1) AS dominant,
  max(n)::DOUBLE / sum(n) AS score, count(*) AS styles FROM np),
ext AS (SELECT extension, naming, count(*) AS n, min(path) AS path FROM f WHERE category = 'code' AND extension <> '' GROUP BY ALL),
outl AS (SELECT path, extension, naming FROM ext e WHERE n = 1 AND (SELECT count(*) FROM ext x WHERE x.extension = e.extension) > 1)"""


@query("naming_consistency", f"""{W}, {NCONS} SELECT dominant, round(score, 6) AS score, styles,
CASE WHEN score >= 0.8 THEN 'consistent' WHEN score >= 0.5 THEN 'mostly_consistent' ELSE 'inconsistent' END AS verdict FROM nc""")
def naming_consistency(spark, d):
    return inv.naming_consistency(_code(spark, d)).withColumn("score", F.round("score", 6))


RARE = "CASE WHEN n IN (1, 2, 11) THEN 'vue' ELSE extension END"


@query("naming_outliers", f"""WITH {c.FILES_SQL.replace('files AS', 'files0 AS', 1)},
files AS (SELECT * REPLACE ({RARE} AS extension) FROM files0),
f AS (SELECT *, {CAT} AS category, {BUCKET} AS bucket, {NAMING} AS naming FROM files), {NCONS} SELECT * FROM outl""")
def naming_outliers(spark, d):
    rows = c.files(spark, d).withColumn("extension", F.expr(RARE))
    return inv.naming_outliers(inv.described(rows).where("category = 'code'"))


@query("large_files", f"WITH {c.FILES_SQL} SELECT path, size FROM files WHERE size > {ft.LARGE_FILE}")
def large_files(spark, d):
    return inv.large_files(_files(spark, d)).select("path", "size")


SPARSE = f"""dc AS (SELECT parent, count(*) AS n FROM files GROUP BY ALL),
sparse AS (SELECT directory FROM dirs LEFT JOIN dc ON parent = directory WHERE coalesce(n, 0) <= 1
  AND directory NOT IN (SELECT {DIR.format(x='directory')} FROM dirs))"""


@query("sparse_dirs", f"WITH {c.FILES_SQL}, {DIRS}, {SPARSE} SELECT directory FROM sparse")
def sparse_dirs(spark, d):
    return inv.sparse_dirs(_files(spark, d), ROOT)


@query("crowded_dirs", f"WITH {c.FILES_SQL} SELECT parent AS directory, count(*) AS files FROM files GROUP BY ALL HAVING count(*) > 30")
def crowded_dirs(spark, d):
    return inv.crowded_dirs(_files(spark, d))


ANOM = f"""anom AS (SELECT 'too_many_files_per_dir' AS type, 'warning' AS severity, NULL AS path FROM st WHERE avg_files > 50
UNION ALL SELECT 'deep_nesting', 'warning', NULL FROM st WHERE max_depth > 10
UNION ALL SELECT 'large_file', 'info', path FROM files WHERE size > {ft.LARGE_FILE}
UNION ALL SELECT 'empty_or_single_file_dir', 'info', directory FROM sparse
UNION ALL SELECT 'flat_code_structure', 'warning', NULL FROM (SELECT count(*) AS n FROM f WHERE depth <= 1 AND category = 'code') WHERE n > 10)"""


@query("inventory_anomalies", f"{W}, {DIRS}, {SPARSE}, {ANOM} SELECT * FROM anom")
def inventory_anomalies(spark, d):
    return inv.anomalies(_files(spark, d), ROOT)


RECOMMENDED = f"""{EDGES}, {DIRS}, {SPARSE}, {ANOM}, {NCONS},
k AS (SELECT count(*) FILTER (depth = 1 AND category IN ('code', 'document', 'image', 'audio', 'video')) AS root_files,
  count(*) FILTER (depth <= 1 AND category = 'code') AS flat_code,
  count(*) FILTER (depth <= 1 AND category = 'document' AND naming <> 'project_doc') AS docs,
  count(*) FILTER (depth <= 1 AND category = 'image') AS images,
  count(*) FILTER (category = 'code' AND naming = 'test_file' AND regexp_extract(parent, '([^/]*)$', 1) ILIKE '%test%') AS placed,
  count(*) FILTER (category = 'code' AND naming = 'test_file' AND depth <= 2) AS stray FROM f),
crowd AS (SELECT count(*) AS n FROM dc WHERE n > 30),
hot AS (SELECT count(*) AS n FROM (SELECT dst FROM edges GROUP BY ALL HAVING count(*) >= 3)),
md AS (SELECT count(*) AS n FROM mods WHERE internal >= files),
r AS (SELECT 'directory_structure' AS type, 'warning' AS severity, 'structure' AS area, crowd.n AS affected FROM st, crowd WHERE avg_files > 30 AND crowd.n > 0
UNION ALL SELECT 'deep_nesting', 'warning', 'structure', 0 FROM st WHERE max_depth > 8
UNION ALL SELECT 'file_categorization', 'warning', 'organization', root_files FROM k WHERE root_files > 5
UNION ALL SELECT 'code_organization', 'warning', 'organization', flat_code FROM k WHERE flat_code > 10
UNION ALL SELECT 'document_organization', 'info', 'organization', docs FROM k WHERE docs > 3
UNION ALL SELECT 'asset_organization', 'info', 'organization', images FROM k WHERE images > 3
UNION ALL SELECT 'naming_inconsistency', 'warning', 'naming', least(20, (SELECT count(*) FROM outl)) FROM nc WHERE score < 0.5
UNION ALL SELECT 'multiple_naming_styles', 'info', 'naming', 0 FROM nc WHERE styles > 3
UNION ALL SELECT 'module_detection', 'info', 'architecture', 0 FROM md WHERE n > 0
UNION ALL SELECT 'dependency_hotspots', 'info', 'architecture', least(5, hot.n) FROM md, hot WHERE md.n > 0 AND hot.n > 0
UNION ALL SELECT 'test_organization', 'info', 'organization', stray FROM k WHERE placed = 0 AND stray > 0),
recs AS (SELECT type, severity, area, affected, NULL AS path, CASE severity WHEN 'warning' THEN 2 ELSE 3 END::BIGINT AS rank FROM r
UNION ALL SELECT 'anomaly_' || type, severity, CASE type WHEN 'large_file' THEN 'performance' WHEN 'flat_code_structure' THEN 'organization' ELSE 'structure' END,
  (path IS NOT NULL)::BIGINT, path, CASE severity WHEN 'warning' THEN 2 ELSE 3 END::BIGINT FROM anom)"""


@query("recommendations", f"WITH {RECOMMENDED} SELECT * FROM recs")
def recommendations(spark, d):
    return inv.recommendations(_files(spark, d), _edges(spark, d), ROOT)


LAYOUT = f"""layout AS (SELECT path AS source, '{ROOT}/' || CASE WHEN category = 'code' AND naming = 'test_file' THEN 'tests' WHEN category = 'code' THEN 'src'
  WHEN category = 'document' AND naming = 'project_doc' THEN NULL WHEN category = 'image' THEN 'assets/images' WHEN category = 'audio' THEN 'assets/audio'
  WHEN category = 'video' THEN 'assets/videos' WHEN category = 'document' THEN 'documents' WHEN category = 'archive' THEN 'archive' || 's'
  WHEN category = 'config' THEN 'config' ELSE 'misc' END || '/' || name AS target FROM f WHERE depth = 1)"""


@query("target_layout", f"{W}, {LAYOUT} SELECT * FROM layout WHERE target IS NOT NULL AND source <> target")
def target_layout(spark, d):
    return inv.target_layout(_files(spark, d), ROOT)


LANGS = values([(e, n, ft.PREFERRED_NAMING.get(n)) for e, n in ft.LANGUAGES.items()], "extension, language, preferred")


@query("language_mix", f"""{W} SELECT language, preferred, count(*) AS files FROM f JOIN {LANGS} l USING (extension)
WHERE category = 'code' GROUP BY ALL ORDER BY files DESC, language LIMIT 3""")
def language_mix(spark, d):
    return inv.language_mix(_code(spark, d), spark)


SEED = values([(k, f"智能推荐 - {lb}归类", 50, "extension", e, fo) for k, e, fo, lb in ft.SUGGESTED]
              + [("test_file", "智能推荐 - 测试文件归集", 45, "filename_keyword", "test,spec,__tests__,unittest", "tests")],
              "present, name, priority, condition_type, condition_value, target_dir")


SUGGESTED = f"""SELECT name, priority, condition_type, condition_value, target_dir FROM {SEED} s
WHERE present IN (SELECT category FROM f) OR present IN (SELECT naming FROM f WHERE naming = 'test_file')"""


@query("suggested_rules", f"{W} {SUGGESTED}")
def suggested_rules(spark, d):
    return inv.suggested_rules(_files(spark, d), spark)


@query("structure_comparison", f"""{W}, {DIRS}, {LAYOUT},
ch AS (SELECT {DIR.format(x='directory')} AS parent, directory AS path, TRUE AS is_dir FROM dirs
  UNION ALL SELECT parent, path, FALSE FROM files),
rk AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, path) AS position,
  greatest(count(*) OVER (PARTITION BY parent) - 50, 0) AS hidden FROM ch WHERE len(string_split(parent, '/')) - 2 <= 4)
SELECT 'current' AS side, parent, path, is_dir, position, hidden FROM rk WHERE position <= 50
UNION ALL SELECT 'move', substr(source, {len(ROOT) + 2}), substr(target, {len(ROOT) + 2}), FALSE, 0, 0 FROM layout
WHERE target IS NOT NULL AND source <> target""")
def structure_comparison(spark, d):
    files = _files(spark, d)
    cut = len(ROOT) + 2
    moves = inv.target_layout(files, ROOT).select(
        F.lit("move").alias("side"), F.expr(f"substring(source, {cut})").alias("parent"),
        F.expr(f"substring(target, {cut})").alias("path"), F.lit(False).alias("is_dir"),
        F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("hidden"))
    tree = inv.tree_cut(files, ROOT).select(
        F.lit("current").alias("side"), "parent", "path", "is_dir", F.col("position").cast("long"), "hidden")
    return tree.unionByName(moves)


SNAP = f"""{DESC},
new AS (SELECT path, md5(path || '|' || size) AS sig, size, category FROM f WHERE n % 10 <> 5),
old AS (SELECT path, md5(path || '|' || s) AS sig, s AS size FROM (SELECT path, n, CASE WHEN n % 10 = 4 THEN size + 30000 * (n % 90) ELSE size END AS s
  FROM f) WHERE n % 10 <> 3),
diff AS (SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'removed'
  WHEN o.sig <> w.sig THEN 'modified' ELSE 'unchanged' END AS change, coalesce(o.size, 0) AS old_size, coalesce(w.size, 0) AS new_size, category
  FROM old o FULL JOIN new w ON o.path = w.path)"""


def _diff(spark, d):
    rows = inv.described(c.files(spark, d))
    sig = F.md5(F.concat_ws("|", "path", "size")).alias("signature")
    new = rows.where("n % 10 <> 5").select("path", sig, "size", "category")
    grown = F.when(F.col("n") % 10 == 4, F.col("size") + 30000 * (F.col("n") % 90)).otherwise(F.col("size"))
    old = rows.where("n % 10 <> 3").withColumn("size", grown).select("path", sig, "size", "category")
    path = _scratch(spark, "snapshots")
    first = snapshots.save(old, path)
    old.limit(1).write.parquet(f"{path}/data-of-a-writer-that-failed")  # rows without a manifest are in no snapshot
    second = snapshots.save(new, path)
    return inv.snapshot_diff(snapshots.load(spark, path, first), snapshots.load(spark, path, second))


@query("snapshot_diff", f"WITH {SNAP} SELECT * FROM diff")
def snapshot_diff(spark, d):
    return _diff(spark, d)


@query("snapshot_summary", f"WITH {SNAP} SELECT change, count(*) AS files FROM diff GROUP BY ALL")
def snapshot_summary(spark, d):
    return inv.snapshot_summary(_diff(spark, d))


@query("change_hints", f"""WITH {SNAP}, t AS (SELECT count(*) FILTER (change = 'modified' AND abs(new_size - old_size) > 1048576) AS big,
  count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'added') AS added FROM diff)
SELECT 'bulk_add' AS hint, category, count(*) AS n FROM diff WHERE change = 'added' GROUP BY ALL HAVING count(*) >= 3
UNION ALL SELECT 'large_modifications', NULL, big FROM t WHERE big > 0
UNION ALL SELECT 'files_removed', NULL, removed FROM t WHERE removed > 0
UNION ALL SELECT 'full_rescan', NULL, removed + added FROM t WHERE removed > 0 OR added > 10""")
def change_hints(spark, d):
    return inv.change_hints(_diff(spark, d))
