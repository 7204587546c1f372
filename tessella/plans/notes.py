"""Linked-note queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph as g
from tessella.operators import notes as nt
from tessella.plans import contracts as c
from tessella.plans.registry import query
from tessella.sources.tables import table

N = f"WITH {c.NOTES_SQL}"
AS_OF = "2024-01-30 00:00:00"


def _links(spark, d):
    return nt.extract_links(c.notes(spark, d))


@query("extract_links", f"{N} SELECT src, dst FROM links")
def extract_links(spark, d):
    return _links(spark, d)


@query("outgoing_links", f"{N} SELECT src, dst, title FROM links JOIN notes ON note_id = dst")
def outgoing_links(spark, d):
    return nt.outgoing(_links(spark, d), c.notes(spark, d))


@query("backlinks", f"{N} SELECT dst, src, title FROM links JOIN notes ON note_id = src")
def backlinks(spark, d):
    return nt.incoming(_links(spark, d), c.notes(spark, d))


@query("note_bundle", f"""{N} SELECT note_id, 'note' AS part, note_id AS item, title FROM notes
UNION ALL SELECT note_id, 'tag', tag, tag FROM note_tags
UNION ALL SELECT src, 'outgoing', dst, title FROM links JOIN notes ON note_id = dst
UNION ALL SELECT dst, 'incoming', src, title FROM links JOIN notes ON note_id = src""")
def note_bundle(spark, d):
    return nt.note_bundle(c.notes(spark, d), c.note_tags(spark, d), _links(spark, d))


def _listing(me, other, section, heading):
    return f"""SELECT DISTINCT {me} AS note_id, {section} AS section, '' AS sort_key,
  '---' || chr(10) || chr(10) || '## {heading}' || chr(10) AS block FROM links
UNION ALL SELECT {me}, {section}, title || ' ' || {other}, '- [[' || {other} || ']] ' || title
FROM links JOIN notes ON note_id = {other}"""


@query("note_markdown", f"""{N},
tl AS (SELECT note_id, string_agg('`' || tag || '`', ', ' ORDER BY tag) AS t FROM (SELECT DISTINCT * FROM note_tags) GROUP BY ALL),
md AS (SELECT notes.note_id, 0 AS section, '' AS sort_key, '# ' || title || chr(10) || chr(10) || '**ID**: ' || notes.note_id || chr(10)
  || '**Created**: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || chr(10) || '**Updated**: ' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S') || chr(10)
  || '**Tags**: ' || t || chr(10) || chr(10) || '---' || chr(10) || chr(10) || content || chr(10) AS block
  FROM notes JOIN tl ON tl.note_id = notes.note_id
UNION ALL {_listing('src', 'dst', 1, 'Outgoing Links')} UNION ALL {_listing('dst', 'src', 2, 'Incoming Links')})
SELECT note_id, section, sort_key, md5(block) AS block FROM md""")
def note_markdown(spark, d):
    return nt.note_markdown(c.notes(spark, d), c.note_tags(spark, d), _links(spark, d)).withColumn(
        "block", F.md5("block"))


@query("graph_nodes_edges", f"""{N} SELECT 'node' AS kind, note_id AS id, title AS other FROM notes
UNION ALL SELECT 'edge', src, dst FROM links""")
def graph_nodes_edges(spark, d):
    return nt.graph(c.notes(spark, d), _links(spark, d))


FOLD = ("translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
HITS = (f"{FOLD.format(x='title')} LIKE '%the re%' OR {FOLD.format(x='content')} LIKE '%the re%'")


@query("note_search", f"""{N} SELECT note_id, title, strftime(updated_at, '%Y-%m-%d %H:%M') AS updated
FROM notes WHERE {HITS}""")
def note_search(spark, d):
    return nt.note_search(c.notes(spark, d), " The RE ").select(
        "note_id", "title", F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated"))


@query("search_highlight", f"""{N} SELECT note_id,
regexp_replace(substr(content, 1, 500), '(?i)(the re)', '<mark>\\1</mark>', 'g') AS snippet FROM notes WHERE {HITS}""")
def search_highlight(spark, d):
    return nt.note_search(c.notes(spark, d), "the re").select(
        "note_id", nt.highlight(F.col("content"), "the re").alias("snippet"))


@query("tag_counts", f"""{N} SELECT tag, count(note_id) AS notes FROM tags LEFT JOIN note_tags USING (tag) GROUP BY ALL""")
def tag_counts(spark, d):
    return nt.tag_counts(c.tags(spark, d), c.note_tags(spark, d))


@query("notes_by_tag", f"""{N} SELECT note_id, title FROM notes WHERE source = 'src3'""")
def notes_by_tag(spark, d):
    return nt.notes_by_tag(c.notes(spark, d), c.note_tags(spark, d), "src3").select("note_id", "title")


S = f"{N}, {c.SHARES_SQL}"


@query("share_validity", f"{S} SELECT token, ok AS valid FROM valid")
def share_validity(spark, d):
    return c.shares(spark, d).select("token", nt.share_valid(AS_OF).alias("valid"))


@query("share_listing", f"""{S} SELECT token, note_id, CASE WHEN NOT gone THEN title END AS title, permission, ok AS valid
FROM valid WHERE is_active""")
def share_listing(spark, d):
    left = c.notes(spark, d).where("doc_id % 11 <> 0")
    return nt.share_listing(c.shares(spark, d), left, AS_OF).select(
        "token", "note_id", "title", "permission", "valid")


@query("access_decision", f"""{S},
att AS (SELECT event_id AS attempt_id, md5('share' || (event_id * 31 % 1500)) AS token,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'pw' || (event_id * 31 % 1500) ELSE 'guess' END AS password,
  event_id % 4 = 0 AS wants FROM events),
x AS (SELECT att.*, v.* EXCLUDE (token), v.token AS known FROM att LEFT JOIN valid v ON v.token = att.token),
y AS (SELECT attempt_id, CASE WHEN known IS NULL THEN '404 no share' WHEN NOT is_active THEN '403 revoked'
  WHEN NOT ok THEN '403 expired' WHEN password_hash IS NOT NULL AND coalesce(password, '') = '' THEN '401 password required'
  WHEN password_hash IS NOT NULL AND sha256(password) <> password_hash THEN '403 wrong password'
  WHEN gone THEN '404 note gone' WHEN wants AND permission <> 'write' THEN '403 read only' ELSE '200 ok' END AS r FROM x)
SELECT attempt_id, left(r, 3)::INTEGER AS status, substr(r, 5) AS reason FROM y""")
def access_decision(spark, d):
    k = F.col("event_id") * 31 % 1500
    attempts = table(spark, d, "events").select(
        F.col("event_id").alias("attempt_id"), F.md5(F.concat(F.lit("share"), k.cast("string"))).alias("token"),
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("pw"), k.cast("string")))
        .when(F.col("event_id") % 3 == 2, "guess").alias("password"),
        (F.col("event_id") % 4 == 0).alias("wants_write"))
    left = c.notes(spark, d).where("doc_id % 11 <> 0")
    return nt.access_decision(attempts, c.shares(spark, d), left, AS_OF)


V = f"WITH {c.VERSIONS_SQL}"


@query("version_history", f"""{V} SELECT note_id, version, rank, total FROM (SELECT *,
row_number() OVER (PARTITION BY note_id ORDER BY version DESC) AS rank, count(*) OVER (PARTITION BY note_id) AS total FROM versions)
WHERE rank > 2 AND rank <= 5""")
def version_history(spark, d):
    return nt.version_page(c.versions(spark, d), 3, 2).select(
        "note_id", "version", F.col("rank").cast("long"), "total")


@query("change_summary", f"""{V}, l AS (SELECT *, lag(title) OVER w AS pt, lag(content) OVER w AS pc, row_number() OVER w AS rn
  FROM versions WINDOW w AS (PARTITION BY note_id ORDER BY version)),
p AS (SELECT *, CASE WHEN title <> pt THEN '标题: "' || pt || '" → "' || title || '"' END AS a,
  CASE WHEN content <> pc THEN CASE WHEN length(content) > length(pc) THEN '内容增加 ' || (length(content) - length(pc)) || ' 字符'
    WHEN length(content) < length(pc) THEN '内容减少 ' || (length(pc) - length(content)) || ' 字符' ELSE '内容修改' END END AS b FROM l WHERE rn > 1)
SELECT note_id, version, CASE WHEN a IS NULL AND b IS NULL THEN '未检测到修改' ELSE concat_ws('; ', a, b) END AS summary FROM p""")
def change_summary(spark, d):
    return nt.change_summary(c.versions(spark, d))


SAVED = """saved AS (SELECT note_id, version * 2 + k AS version, title, CASE WHEN k = 1 AND conv_id % 2 = 1 THEN content || '.' ELSE content END AS content
  FROM versions, range(2) t(k))"""


def _saved(spark, d):
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    return c.versions(spark, d).withColumn("k", k).select(
        "note_id", (F.col("version") * 2 + F.col("k")).alias("version"), "title",
        F.when((F.col("k") == 1) & (F.col("conv_id") % 2 == 1), F.concat("content", F.lit(".")))
        .otherwise(F.col("content")).alias("content"))


@query("drop_noop_versions", f"""{V}, {SAVED} SELECT note_id, version FROM (SELECT *, lag(title) OVER w AS pt,
lag(content) OVER w AS pc FROM saved WINDOW w AS (PARTITION BY note_id ORDER BY version))
WHERE pt IS NULL OR title <> pt OR content <> pc""")
def drop_noop_versions(spark, d):
    return nt.drop_noop_versions(_saved(spark, d)).select("note_id", "version")


@query("restore_version", f"""{V}, req AS (SELECT DISTINCT note_id, CASE WHEN conv_id % 2 = 0 THEN conv_id ELSE conv_id + 1 END * 100 AS version_id FROM versions),
cur AS (SELECT note_id, max(version) AS version, arg_max(title, version) AS t, arg_max(content, version) AS x FROM versions GROUP BY ALL)
SELECT v.note_id, cur.version + 1 AS version, v.version AS restored_from, md5(content) AS content FROM req
JOIN versions v USING (note_id, version_id) JOIN cur ON cur.note_id = v.note_id WHERE title <> t OR content <> x""")
def restore_version(spark, d):
    v = c.versions(spark, d)
    req = v.select("note_id", (F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))
                               .otherwise(F.col("conv_id") + 1) * 100).alias("version_id")).distinct()
    return nt.restore_version(v, req).select(
        "note_id", "version", "restored_from", F.md5("content").alias("content"))


CLOSURE = """und AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links)"""


@query("reachable_notes", f"""{N.replace('WITH ', 'WITH RECURSIVE ')}, {CLOSURE},
r AS (SELECT {c.hid_sql('14')} AS node UNION SELECT b FROM r JOIN und ON a = node) SELECT node FROM r""")
def reachable_notes(spark, d):
    return g.reachable(c.notes(spark, d).select("note_id"), _links(spark, d),
                       "aab3238922bcc25a6f606eb525ffdc56"[:12])


@query("note_components", f"""{N.replace('WITH ', 'WITH RECURSIVE ')}, {CLOSURE},
r AS (SELECT note_id AS node, note_id AS other FROM notes UNION SELECT r.node, b FROM r JOIN und ON a = other)
SELECT node, min(other) AS component FROM r GROUP BY ALL""")
def note_components(spark, d):
    return g.components(c.notes(spark, d).select("note_id"), _links(spark, d))


@query("export_all_group", f"""{N.replace('WITH ', 'WITH RECURSIVE ')}, {CLOSURE},
r AS (SELECT * FROM (SELECT note_id AS node FROM notes ORDER BY updated_at DESC, note_id LIMIT 1)
  UNION SELECT b FROM r JOIN und ON a = node) SELECT node FROM r""")
def export_all_group(spark, d):
    return g.newest_group(c.notes(spark, d).select("note_id", "updated_at"), _links(spark, d))


@query("cascade_delete", f"""{N}, {c.SHARES_SQL}, gone AS (SELECT note_id FROM notes WHERE doc_id % 5 = 2)
SELECT 'notes' AS part, note_id AS id, '' AS other FROM notes ANTI JOIN gone USING (note_id)
UNION ALL SELECT 'note_tags', note_id, tag FROM note_tags ANTI JOIN gone USING (note_id)
UNION ALL SELECT 'links', src, dst FROM links WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)
UNION ALL SELECT 'shares', note_id, token FROM shares ANTI JOIN gone USING (note_id)
UNION ALL SELECT 'versions', note_id, md5(text) FROM (SELECT {c.hid_sql('conv_id')} AS note_id, text FROM conversations) ANTI JOIN gone USING (note_id)""")
def cascade_delete(spark, d):
    notes = c.notes(spark, d)
    versions = table(spark, d, "conversations").select(c.hid(F.col("conv_id")).alias("note_id"), "text")
    left = nt.cascade_delete(notes.where("doc_id % 5 = 2"), notes, c.note_tags(spark, d),
                             _links(spark, d), versions, c.shares(spark, d))
    ends = {"notes": ("note_id", F.lit("")), "note_tags": ("note_id", F.col("tag")),
            "links": ("src", F.col("dst")), "shares": ("note_id", F.col("token")),
            "versions": ("note_id", F.md5("text"))}
    out = None
    for part, (key, other) in ends.items():
        rows = left[part].select(F.lit(part).alias("part"), F.col(key).alias("id"), other.alias("other"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("account_quality", f"""WITH a AS (SELECT c_custkey AS id,
  CASE c_custkey % 5 WHEN 0 THEN 'ab' WHEN 1 THEN 'user_' || c_custkey WHEN 2 THEN 'user_' || (c_custkey - c_custkey % 3)
    WHEN 3 THEN c_name ELSE repeat('x', 25) || c_custkey END AS u,
  CASE c_custkey % 4 WHEN 0 THEN 'u' || c_custkey || '@example.com' WHEN 1 THEN 'bad@' WHEN 2 THEN 'dup@example.org' END AS m FROM customer)
SELECT id AS account_id, 'username_too_short' AS rule FROM a WHERE length(u) < 3
UNION ALL SELECT id, 'username_too_long' FROM a WHERE length(u) > 20
UNION ALL SELECT id, 'username_characters' FROM a WHERE NOT regexp_matches(u, '{nt.USERNAME}')
UNION ALL SELECT id, 'username_taken' FROM a WHERE id > (SELECT min(b.id) FROM a b WHERE b.u = a.u)
UNION ALL SELECT id, 'email_missing' FROM a WHERE m IS NULL
UNION ALL SELECT id, 'email_format' FROM a WHERE NOT regexp_matches(m, '{nt.EMAIL}')
UNION ALL SELECT id, 'email_taken' FROM a WHERE id > (SELECT min(b.id) FROM a b WHERE b.m = a.m)""")
def account_quality(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("account_id"),
        F.expr("CASE c_custkey % 5 WHEN 0 THEN 'ab' WHEN 1 THEN concat('user_', c_custkey) "
               "WHEN 2 THEN concat('user_', c_custkey - c_custkey % 3) WHEN 3 THEN c_name "
               "ELSE concat(repeat('x', 25), c_custkey) END").alias("username"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('u', c_custkey, '@example.com') WHEN 1 THEN 'bad@' "
               "WHEN 2 THEN 'dup@example.org' END").alias("email"))
    return nt.account_quality(rows)
