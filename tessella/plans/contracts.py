"""How the given tables stand in for the application's records.

Each contract exists twice: as a DataFrame for the operators and as a DuckDB
common table expression for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import table

AS_OF = "2024-01-30"

# ---------------------------------------------------------------- habits (events)

CATEGORY_OF = {"click": "health", "view": "learning", "signup": "social",
               "purchase": "finance", "error": "lifestyle"}


def _case(mapping: dict, col: str) -> str:
    return "CASE " + col + " " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


CHECKINS_SQL = """checkins AS (
  SELECT event_id AS checkin_id, user_id, user_id || '-' || event_type AS habit_id,
    CAST(ts AS DATE) AS date, CASE WHEN value >= 100 THEN 'makeup' ELSE 'normal' END AS type,
    ts AS created_at FROM events),
days AS (SELECT habit_id, user_id, date, arg_min(checkin_id, created_at) AS checkin_id,
    arg_min(type, created_at) AS type, min(created_at) AS created_at
  FROM checkins GROUP BY habit_id, user_id, date)"""

HABITS_SQL = f"""habits AS (
  SELECT user_id || '-' || event_type AS habit_id, user_id, event_type AS name,
    {_case(CATEGORY_OF, 'event_type')} AS category,
    CASE user_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS frequency_type,
    1 + user_id % 4 AS frequency_count, CAST(min(ts) AS DATE) AS created_on
  FROM events GROUP BY user_id, event_type)"""

HABIT_CTES = f"{CHECKINS_SQL}, {HABITS_SQL}"


def checkins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("checkin_id"), "user_id",
        F.concat_ws("-", "user_id", "event_type").alias("habit_id"),
        F.to_date("ts").alias("date"),
        F.when(F.col("value") >= 100, "makeup").otherwise("normal").alias("type"),
        F.col("ts").alias("created_at"))


def habits(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.to_date(F.min("ts")).alias("created_on"))
    return ev.select(
        F.concat_ws("-", "user_id", "event_type").alias("habit_id"), "user_id",
        F.col("event_type").alias("name"),
        F.expr(_case(CATEGORY_OF, "event_type")).alias("category"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END")
        .alias("frequency_type"),
        (1 + F.col("user_id") % 4).alias("frequency_count"), "created_on")


# ------------------------------------------------- posts, comments, likes, friends

SOCIAL_SQL = """posts AS (SELECT conv_id AS post_id, conv_id % 150 AS user_id,
    TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 720 AS INTEGER)) AS created_at, text
  FROM conversations WHERE turn = 0),
comments AS (SELECT conv_id * 100 + turn AS comment_id, conv_id AS post_id,
    (conv_id + turn) % 150 AS user_id FROM conversations WHERE turn > 0),
like_events AS (SELECT event_id * 7 % 100 AS post_id, user_id, ts,
    event_type = 'click' AS liked FROM events WHERE event_type IN ('click', 'error')),
friend_events AS (SELECT user_id, event_id * 13 % 150 AS friend_id, ts,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'accepted'
      ELSE 'removed' END AS status
  FROM events WHERE event_type IN ('signup', 'purchase', 'view'))"""


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("turn = 0").select(
        F.col("conv_id").alias("post_id"), (F.col("conv_id") % 150).alias("user_id"),
        F.timestamp_seconds(1704067200 + F.col("conv_id") % 720 * 3600).alias("created_at"), "text")


def comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("turn > 0").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("comment_id"),
        F.col("conv_id").alias("post_id"),
        ((F.col("conv_id") + F.col("turn")) % 150).alias("user_id"))


def like_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type").isin("click", "error")).select(
        (F.col("event_id") * 7 % 100).alias("post_id"), "user_id", "ts",
        (F.col("event_type") == "click").alias("liked"))


def friend_events(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "view"))
            .select("user_id", (F.col("event_id") * 13 % 150).alias("friend_id"), "ts",
                    F.when(F.col("event_type") == "signup", "pending")
                    .when(F.col("event_type") == "purchase", "accepted")
                    .otherwise("removed").alias("status")))

# ----------------------------------------------------------- notes (documents)

HID = "substr(md5(CAST({x} AS VARCHAR)), 1, 12)"


def hid_sql(x: str) -> str:
    return HID.format(x=x)


NOTES_SQL = f"""notes AS (SELECT {hid_sql('doc_id')} AS note_id, 'Note ' || doc_id || ' ' || source AS title,
    text || ' [[' || {hid_sql('doc_id - doc_id % 7')} || ']]'
      || CASE WHEN doc_id % 7 = 0 THEN ' [[' || {hid_sql('doc_id * 2')} || ']]' ELSE '' END AS content,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 7 % 1000 AS INTEGER)) AS updated_at,
    doc_id, lang, source FROM documents),
note_tags AS (SELECT note_id, source AS tag FROM notes UNION ALL SELECT note_id, lang FROM notes),
tags AS (SELECT DISTINCT tag FROM note_tags UNION SELECT n_name FROM nation),
found AS (SELECT DISTINCT note_id AS src, unnest(regexp_extract_all(content, '\\[\\[([a-f0-9]{{12}})\\]\\]', 1)) AS dst FROM notes),
links AS (SELECT src, dst FROM found WHERE src <> dst AND dst IN (SELECT note_id FROM notes))"""


def hid(x):
    return F.substring(F.md5(x.cast("string")), 1, 12)


def notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        hid(k).alias("note_id"), F.concat_ws(" ", F.lit("Note"), "doc_id", "source").alias("title"),
        F.concat("text", F.lit(" [["), hid(k - k % 7), F.lit("]]"),
                 F.when(k % 7 == 0, F.concat(F.lit(" [["), hid(k * 2), F.lit("]]")))
                 .otherwise("")).alias("content"),
        F.timestamp_seconds(1704067200 + k * 60).alias("created_at"),
        F.timestamp_seconds(1704067200 + k * 7 % 1000 * 3600).alias("updated_at"),
        "doc_id", "lang", "source")


def note_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        hid(F.col("doc_id")).alias("note_id"), F.explode(F.array("source", "lang")).alias("tag"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    return note_tags(spark, d).select("tag").distinct().union(
        table(spark, d, "nation").select("n_name")).distinct()


SHARES_SQL = """shares AS (SELECT md5('share' || doc_id) AS token, note_id, title,
    CASE WHEN doc_id % 2 = 0 THEN 'write' ELSE 'read' END AS permission,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '2024-01-20 00:00:00' WHEN 2 THEN '2024-02-20 10:00:00'
      WHEN 3 THEN 'soon' ELSE '2024-01-30 00:00:00' END AS expires_at,
    doc_id % 4 <> 0 AS is_active, CASE WHEN doc_id % 3 = 0 THEN sha256('pw' || doc_id) END AS password_hash,
    doc_id % 11 = 0 AS gone, created_at FROM notes),
valid AS (SELECT *, is_active AND NOT coalesce(TIMESTAMP '2024-01-30' > TRY_CAST(expires_at AS TIMESTAMP), FALSE) AS ok FROM shares)"""


def shares(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return notes(spark, d).select(
        F.md5(F.concat(F.lit("share"), k.cast("string"))).alias("token"), "note_id",
        F.when(k % 2 == 0, "write").otherwise("read").alias("permission"),
        F.expr("CASE doc_id % 5 WHEN 1 THEN '2024-01-20 00:00:00' WHEN 2 THEN '2024-02-20 10:00:00' "
               "WHEN 3 THEN 'soon' WHEN 4 THEN '2024-01-30 00:00:00' END").alias("expires_at"),
        (k % 4 != 0).alias("is_active"),
        F.when(k % 3 == 0, F.sha2(F.concat(F.lit("pw"), k.cast("string")), 256)).alias("password_hash"),
        "created_at")


VERSIONS_SQL = """versions AS (SELECT 'n' || conv_id AS note_id, conv_id * 100 + turn AS version_id,
    turn AS version, role AS title, text AS content, conv_id FROM conversations)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.concat(F.lit("n"), "conv_id").alias("note_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("version_id"),
        F.col("turn").alias("version"), F.col("role").alias("title"), F.col("text").alias("content"),
        "conv_id")

# ------------------------------------------------------ files (documents, pages)

FILE_ROOT = "/data"
EXTS = ["py", "txt", "jpg", "js", "md", "mp3", "go", "json", "zip", "java", "ts", "mp4", "c", "ini", "pdf"]


def _pick(k: str, items: list[str], n: int) -> str:
    return f"CASE {k} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(items)) + " END"


def ext_expr(k: str) -> str:
    return _pick(k, [f"'{e}'" for e in EXTS], len(EXTS))


def stem_expr(k: str) -> str:
    return _pick(k, [f"concat('mod_', {k})", f"concat('page-item', {k})", f"concat('Report', {k})",
                     f"concat('dataSet', {k})", f"concat('MAX_', {k})",
                     f"concat('2024-01-', 10 + {k} % 20, '-x ', {k})", f"concat('a b.', {k})",
                     f"concat('unit test ', {k})", f"concat('README file ', {k})"], 9)


def name_expr(k: str) -> str:
    return f"concat({stem_expr(k)}, '.', {ext_expr(k)})"


def files_sql(div: str) -> str:
    """The same text runs in both engines; only integer division differs."""
    k = "doc_id"
    folder = _pick(k, ["'/data'", "concat('/data/', source)", "concat('/data/', source)",
                       "concat('/data/', source, '/', lang)", "concat('/data/', source, '/', lang)",
                       f"concat('/data/', source, '/', lang, '/d', doc_id {div} 100, '/a/b/c/e/f/g/h')",
                       f"concat('/data/mods/g', doc_id {div} 210)"], 7)
    up = _pick(k, ["'./'", "'../'", "'../'", "'../../'", "'../../'", "'./'", "'./'"], 7)
    return f"""SELECT concat({folder}, '/', {name_expr(k)}) AS path, {name_expr(k)} AS name,
    {ext_expr(k)} AS extension, n_chars * CASE WHEN doc_id % 50 = 0 THEN 40000 ELSE 37 END AS size,
    doc_id AS n, {folder} AS parent, {up} AS up, text FROM documents"""


FILES_SQL = f"""files AS (SELECT path, name, extension, CAST(size AS BIGINT) AS size,
    TIMESTAMP '2023-06-01' + to_days(CAST(n % 400 AS INTEGER)) + to_hours(CAST(n % 24 AS INTEGER)) AS modified_time,
    TIMESTAMP '2023-05-31' + to_days(CAST(n % 400 AS INTEGER)) + to_hours(CAST(n % 24 AS INTEGER)) AS created_time,
    parent, len(string_split(path, '/')) - 2 AS depth, n, up, text FROM ({files_sql('//')})
  UNION ALL SELECT '/data/web/p' || page_id || '.html', 'p' || page_id || '.html', 'html', length(html),
    TIMESTAMP '2023-12-01' + to_days(CAST(page_id % 60 AS INTEGER)), TIMESTAMP '2023-11-30' + to_days(CAST(page_id % 60 AS INTEGER)),
    '/data/web', 2, -1 - page_id, '', html FROM pages)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """Inventory rows with the columns the contract names, plus n, up and text."""
    from_docs = spark.sql(files_sql("div").replace("FROM documents", "FROM {t}"),
                          t=table(spark, d, "documents"))
    base = F.unix_timestamp(F.lit("2023-06-01").cast("timestamp"))
    n = F.col("n")
    at = base + n % 400 * 86400 + n % 24 * 3600
    docs = from_docs.select(
        "path", "name", "extension", "size", F.timestamp_seconds(at).alias("modified_time"),
        F.timestamp_seconds(at - 86400).alias("created_time"), "parent",
        (F.size(F.split("path", "/")) - 2).alias("depth"), "n", "up", "text")
    p = F.col("page_id")
    web = F.unix_timestamp(F.lit("2023-12-01").cast("timestamp")) + p % 60 * 86400
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("/data/web/p"), p, F.lit(".html")).alias("path"),
        F.concat(F.lit("p"), p, F.lit(".html")).alias("name"), F.lit("html").alias("extension"),
        F.length("html").cast("long").alias("size"), F.timestamp_seconds(web).alias("modified_time"),
        F.timestamp_seconds(web - 86400).alias("created_time"), F.lit("/data/web").alias("parent"),
        F.lit(2).alias("depth"), (-1 - p).alias("n"), F.lit("").alias("up"), F.col("html").alias("text"))
    return docs.unionByName(pages)


def _source_lines(near: str, far: str) -> str:
    return (f"concat('import os', chr(10), 'from pkg.mod', n % 5, ' import x', chr(10), '#include \"h', n % 4, '.h\"', chr(10), "
            f"'x = \"github.com/a/b', n % 3, '\" + \"plain\"', chr(10), {far}, {near}, text)")


FAR = f"CASE WHEN n < 0 THEN '' ELSE concat('import ''', up, {name_expr('(n - n % 7)')}, '''', chr(10)) END"
NEAR_LINE = f"concat('import ''./', {name_expr('greatest(n + 7 * i, 0)')}, '''', chr(10))"
TEXTS_SQL = f"""texts AS (SELECT path, extension, {_source_lines(
    "array_to_string(list_transform(range(-6, 7), lambda i: " + NEAR_LINE + "), '')", FAR)} AS text FROM files)"""


def source_texts(spark: SparkSession, d: str) -> DataFrame:
    """Inventory files with import lines put before their text."""
    near = f"array_join(transform(sequence(-6, 6), i -> {NEAR_LINE}), '')"
    return spark.sql(f"SELECT path, extension, {_source_lines(near, FAR)} AS text FROM {{t}}",
                     t=files(spark, d))
