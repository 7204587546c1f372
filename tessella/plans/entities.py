"""Entity queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.data import entities as ed
from tessella.functions import text as tx
from tessella.operators import entities as en
from tessella.plans.registry import query
from tessella.plans.sentiment import LANG
from tessella.plans.sqlparts import values
from tessella.sources.tables import spread, table

TEXT = ("concat(text, CASE doc_id % 5 WHEN 0 THEN concat(' Dr. Anna Smith met Google in London City on 2024-01-', 10 + doc_id % 19, '.') "
        "WHEN 1 THEN concat(' Ordered at ', 10 + doc_id % 12, ':', 10 + doc_id % 49, ' in 19', 10 + doc_id % 80, ', Python API') "
        "WHEN 2 THEN ' 王小明先生昨天在北京清华大学说人工智能。 华星科技有限公司 海州市 李总' WHEN 3 THEN ' The North Star Trading Company and Mary Jane Poppins today' ELSE '' END)")
DOCS = f"docs AS (SELECT doc_id, {TEXT} AS text FROM documents)"


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", F.expr(TEXT).alias("text")))


OWN_NAMES = [("北京", "LOC", 0.92), ("清华大学", "ORG", 0.90), ("人工智能", "NOUN", 0.90), ("昨天", "TIME", 0.91),
             ("Python", "NOUN", 0.90), ("API", "NOUN", 0.90)]  # of the texts put in above
GAZ = f"""{DOCS}, gaz AS (SELECT * FROM {values(OWN_NAMES, 'name, type, confidence')}
  UNION ALL SELECT upper(n_name[1]) || lower(n_name[2:]), 'LOC', 0.92 FROM nation
  UNION ALL SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{7,}}')), 'NOUN', 0.85 FROM benchmark),
gp AS (SELECT doc_id, name, type, confidence::DOUBLE AS confidence, string_split(text, name) AS p FROM docs, gaz WHERE contains(text, name)),
gs AS (SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(name))::INTEGER AS start, name AS text, type, confidence
  FROM (SELECT *, unnest(range(1, len(p))) AS i FROM gp)),
gazetteer AS (SELECT doc_id, start, (start + length(text))::INTEGER AS "end", text, type, confidence FROM gs)"""


def _names(spark, d):
    """Names of nations, long words of the benchmark, and those of the texts put in."""
    own = spark.createDataFrame(OWN_NAMES, "name string, type string, confidence double")
    nations = table(spark, d, "nation").select(
        F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)"))), F.lit("LOC"), F.lit(0.92))
    words = table(spark, d, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[a-z]{7,}"), F.lit(0))), F.lit("NOUN"), F.lit(0.85)).distinct()
    return own.union(nations).union(words)


@query("gazetteer_entities", f"WITH {GAZ} SELECT * FROM gazetteer")
def gazetteer_entities(spark, d):
    return _rows(spark, d, en.gazetteer_spans(F.col("text"), [tuple(r) for r in _names(spark, d).collect()]))


@query("gazetteer_entities_join", f"WITH {GAZ} SELECT * FROM gazetteer")
def gazetteer_entities_join(spark, d):
    return en.gazetteer_entities(_docs(spark, d), "doc_id", _names(spark, d))


# Only the patterns that can occur in these texts; digits decide bare years.
TIME = f"""tp AS (SELECT * FROM (VALUES ('\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}', 0.95), ('\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?', 0.92), ('\\d+', 0.88)) v(pat, confidence)),
tm AS (SELECT doc_id, pat, confidence::DOUBLE AS confidence, regexp_extract_all(text, pat) AS m, regexp_split_to_array(text, pat) AS g FROM docs, tp),
ts AS (SELECT doc_id, pat, confidence, m[i] AS text, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM tm)),
times AS (SELECT doc_id, start, (start + length(text))::INTEGER AS "end", text, 'TIME' AS type, confidence FROM ts
  WHERE pat <> '\\d+' OR (length(text) = 4 AND (text LIKE '19%' OR text LIKE '20%')))"""


def _times(spark, d):
    return _rows(spark, d, en.time_spans(F.col("text")))


@query("time_entities", f"WITH {DOCS}, {TIME} SELECT * FROM times")
def time_entities(spark, d):
    return _times(spark, d)


def _rows(spark, d, column):
    return en.span_rows(_docs(spark, d), "doc_id", column)


RUNS = """rm AS (SELECT doc_id, text, regexp_extract_all(text, '[一-龥]+') AS m, regexp_split_to_array(text, '[一-龥]+') AS g FROM docs),
rs AS (SELECT doc_id, text AS whole, m[i] AS run, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM rm)),
runs AS (SELECT *, CASE WHEN start > 0 THEN substr(whole, start, 1) ELSE '' END AS prev, substr(whole, start + 1, 40) AS rest FROM rs)"""
SPAN = """doc_id, start, (start + length(text))::INTEGER AS "end", text, type, confidence::DOUBLE AS confidence"""


def _suffixes() -> str:
    """The patterns look back on Chinese characters, so they match from the start of a run only."""
    parts = []
    for pattern, kind, confidence, least in ed.SUFFIX_PATTERNS:
        stops, body = pattern.removeprefix("(?<!").split(")", 1)
        parts.append(f"SELECT doc_id, start, regexp_extract(run, '^{body}') AS text, '{kind}' AS type, {confidence} AS confidence, {least} AS least "
                     f"FROM runs WHERE NOT regexp_matches(prev, '{stops}')")
    return f"suffixes AS (SELECT {SPAN} FROM ({' UNION ALL '.join(parts)}) WHERE length(text) BETWEEN least AND 20)"


def _persons() -> str:
    office = rf"({ed.TITLES})([一-龥]{{2,3}})([，。！？；：\s说表示]|$)"
    return f"""titled AS (SELECT doc_id, start, s, regexp_extract(rest, '^[一-龥]{{1,3}}' || s) AS text FROM runs, {values([(x,) for x in ed.PERSON_SUFFIXES], 's')}),
om AS (SELECT doc_id, text, regexp_extract_all(text, '{office}') AS m, regexp_split_to_array(text, '{office}') AS g FROM docs),
os AS (SELECT doc_id, m[i] AS hit, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM om)),
persons AS (SELECT {SPAN.replace('type', "'PER' AS type", 1)} FROM (
  SELECT doc_id, start, text, CASE WHEN regexp_matches(text, '^[{ed.SURNAMES}]') THEN 0.88 ELSE 0.82 END AS confidence FROM titled
    WHERE length(text) BETWEEN 2 AND 8 AND (regexp_matches(text, '^[{ed.SURNAMES}]') OR length(text) - length(s) >= 2)
  UNION ALL SELECT doc_id, start, run, 0.86 FROM runs WHERE regexp_matches(run, '^[{ed.SURNAMES}][{ed.SHORT_TITLES}]$') AND NOT regexp_matches(prev, '[a-zA-Z]')
  UNION ALL SELECT doc_id, start, regexp_extract(run, '^([一-龥]{{2,3}})({ed.SPEECH})', 1), 0.86 FROM runs
    WHERE regexp_matches(prev, '[，。！？；：\\s]') AND regexp_matches(regexp_extract(run, '^([一-龥]{{2,3}})({ed.SPEECH})', 1), '^[{ed.SURNAMES}]')
  UNION ALL SELECT doc_id, (start + length(regexp_extract(hit, '{office}', 1)))::INTEGER, regexp_extract(hit, '{office}', 2), 0.84 FROM os))"""


@query("suffix_entities", f"WITH {DOCS}, {RUNS}, {_suffixes()} SELECT * FROM suffixes")
def suffix_entities(spark, d):
    return _rows(spark, d, en.suffix_spans(F.col("text")))


@query("person_entities", f"WITH {DOCS}, {RUNS}, {_persons()} SELECT * FROM persons")
def person_entities(spark, d):
    return _rows(spark, d, en.person_spans(F.col("text")))


def _english() -> str:
    """Stage after stage, each without what touches an earlier span. The bare year needs
    looks to both sides; digit runs of four say the same. DuckDB's word bounds know only
    ASCII, so other letters are matched as an underscore, and texts cut from the original."""
    words = lambda lo, hi: f"len(regexp_extract_all(text, '\\S+')) BETWEEN {lo} AND {hi}"
    stages = [(ed.ENGLISH_TITLED, "PER", 0.88, "TRUE"), (ed.ENGLISH_NAME, "PER", 0.85, words(2, 3)),
              ("(?i)" + ed.ENGLISH_ORG, "ORG", 0.82, words(3, 6)), (ed.ENGLISH_LOCATION, "LOC", 0.80, words(2, 5)),
              *[(p, "TIME", v, "TRUE") for p, v in ed.ENGLISH_TIMES[:-1]],
              (r"\d+", "TIME", ed.ENGLISH_TIMES[-1][1], "regexp_full_match(text, '(19|20)[0-9][0-9]')")]
    parts = [f"""k0 AS MATERIALIZED (SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(name))::INTEGER AS start,
  name AS text, 'ORG' AS type, 0.92::DOUBLE AS confidence FROM (SELECT *, unnest(range(1, len(p))) AS i FROM
  (SELECT doc_id, name, string_split(text, name) AS p FROM plain, {values([(n,) for n in ed.ENGLISH_ORGS], 'name')} WHERE contains(text, name))))"""]
    for i, (pattern, kind, confidence, keep) in enumerate(stages):
        parts.append(f"""m{i} AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM plain),
s{i} AS MATERIALIZED (SELECT doc_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS start,
  m[i] AS text, '{kind}' AS type, {confidence}::DOUBLE AS confidence FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{i})),
k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} UNION ALL SELECT * FROM s{i} s WHERE {keep} AND NOT EXISTS (SELECT 1 FROM k{i} k
  WHERE k.doc_id = s.doc_id AND s.start + length(s.text) > k.start AND s.start < k.start + length(k.text)))""")
    plain = "plain AS (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ɏ一-龥]', '_', 'g') AS text FROM docs)"
    return plain + ", " + ",\n".join(parts) + f""", english AS (SELECT k.doc_id, start, (start + length(k.text))::INTEGER AS "end",
substr(docs.text, start + 1, length(k.text)) AS text, type, confidence FROM k{len(stages)} k JOIN docs ON docs.doc_id = k.doc_id)"""


@query("english_entities", f"WITH {DOCS}, {_english()} SELECT * FROM english")
def english_entities(spark, d):
    return _rows(spark, d, en.english_spans(F.col("text")))


CANDIDATES = f"""{GAZ}, {TIME}, {RUNS}, {_suffixes()}, {_persons()}, {_english()},
cand AS MATERIALIZED (SELECT *, 1 AS src FROM gazetteer UNION ALL SELECT *, 2 FROM times UNION ALL SELECT *, 3 FROM suffixes
  UNION ALL SELECT *, 4 FROM persons UNION ALL SELECT *, 5 FROM english WHERE doc_id IN (SELECT doc_id FROM docs WHERE ({LANG}) = 'english'))"""


def _post(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT s.doc_id, s.start, s."end", s.text, type,
  least(0.99, CASE WHEN confidence < 0.5 THEN 0.5 + least(0.4, length(s.text) * 0.015) ELSE confidence END)::DOUBLE AS confidence, src
  FROM {source} s JOIN docs USING (doc_id) WHERE start >= 0 AND s."end" <= length(docs.text) AND s."end" > start
  AND regexp_matches(s.text, '{tx.NON_SPACE}') AND (length(s.text) <= 30 OR type IN ('ORG', 'LOC'))
  AND (type NOT IN ('ORG', 'LOC', 'NOUN') OR regexp_matches(s.text, '[一-龥a-zA-Z]')))"""


def _sweep(name: str, source: str, order: str, joined: str, steps: str) -> str:
    """Spans of a text one after the other; `steps`: what becomes of the list of those kept."""
    return f"""{name}_n AS MATERIALIZED (SELECT doc_id, {{'start': start, 'end': "end", 'text': text, 'type': type, 'confidence': confidence}} AS e,
  row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS n FROM {source}),
{name}_f AS (SELECT doc_id, n, [e] AS kept FROM {name}_n WHERE n = 1
  UNION ALL SELECT f.doc_id, x.n, CASE {steps} END FROM (SELECT *, kept[len(kept)] AS p FROM {name}_f) f JOIN {name}_n x ON x.doc_id = f.doc_id AND x.n = f.n + 1 {joined}),
{name} AS MATERIALIZED (SELECT doc_id, e.start AS start, e."end" AS "end", e.text AS text, e.type AS type, e.confidence AS confidence, 1 AS src
  FROM (SELECT doc_id, unnest(kept) AS e FROM (SELECT doc_id, max_by(kept, n) AS kept FROM {name}_f GROUP BY doc_id)))"""


def _resolve(name: str, source: str) -> str:
    weak = ", ".join(f"'{x}'" for x in ed.WEAK_PLACE_PREFIX)
    replaces = f"""x.e.confidence - p.confidence > 0.10 OR p."end" - p.start <= 2 OR p.type = 'LOC' AND p.text[1] IN ({weak})
    OR x.e.type = 'PER' AND p.type = 'LOC' AND length(x.e.text) <= 4 AND x.e.confidence >= 0.85
    OR x.e.type = 'TIME' AND p.type <> 'TIME' AND x.e.confidence >= 0.90
    OR x.e."end" - x.e.start > (p."end" - p.start) * 1.5 AND x.e.confidence - p.confidence > -0.05"""
    return _sweep(name, source, 'start, "end" DESC, confidence DESC, src', "", f"""WHEN x.e.start >= p."end" THEN list_append(kept, x.e)
    WHEN {replaces} THEN list_append(kept[1:len(kept) - 1], x.e) ELSE kept""")


def _merge(name: str, source: str) -> str:
    joiners = ", ".join(f"'{x}'" for x in ed.JOINERS)
    return _sweep(name, source, "start", "JOIN docs ON docs.doc_id = f.doc_id", f"""WHEN x.e.type = p.type AND x.e.start - p."end" BETWEEN 1 AND 2
      AND trim(substr(docs.text, p."end" + 1, x.e.start - p."end")) IN ({joiners})
    THEN list_append(kept[1:len(kept) - 1], {{'start': p.start, 'end': x.e."end", 'text': substr(docs.text, p.start + 1, x.e."end" - p.start), 'type': p.type,
      'confidence': (p.confidence + x.e.confidence) / 2}}) ELSE list_append(kept, x.e)""")


COLUMNS = 'doc_id, start, "end", text, type, confidence'
FOUND = f"""WITH RECURSIVE {CANDIDATES}, {_post('posted', 'cand')}, {_resolve('kept', 'posted')}, {_merge('merged', 'kept')}, {_post('found', 'merged')}"""


def _candidates(spark, d):
    return en.with_candidates(_docs(spark, d), "doc_id", _names(spark, d))


def _found(spark, d):
    return en.recognize(_docs(spark, d), "doc_id", _names(spark, d))


@query("resolve_overlaps", f"WITH RECURSIVE {CANDIDATES}, {_resolve('kept', 'cand')} SELECT {COLUMNS} FROM kept")
def resolve_overlaps(spark, d):
    return en.span_rows(_candidates(spark, d), "doc_id", en.resolve_overlaps(F.col("candidates")))


@query("merge_adjacent", f"WITH RECURSIVE {CANDIDATES}, {_resolve('kept', 'cand')}, {_merge('merged', 'kept')} SELECT {COLUMNS} FROM merged")
def merge_adjacent(spark, d):
    rows = _candidates(spark, d).withColumn("kept", en.resolve_overlaps(F.col("candidates")))
    return en.span_rows(rows, "doc_id", en.merge_adjacent(F.col("kept"), F.col("text")))


@query("entity_postprocess", f"WITH {CANDIDATES}, {_post('posted', 'cand')} SELECT {COLUMNS} FROM posted")
def entity_postprocess(spark, d):
    return en.span_rows(_candidates(spark, d), "doc_id", en.postprocess(F.col("candidates"), F.col("text")))


@query("recognize_entities", f"{FOUND} SELECT {COLUMNS} FROM found")
def recognize_entities(spark, d):
    return en.entity_rows(_found(spark, d), "doc_id")


@query("entity_stats", f"""{FOUND} SELECT doc_id, {', '.join(f"count(*) FILTER (type = '{t}') AS {t}" for t in ed.TYPES)}, count(*) AS total FROM found GROUP BY ALL""")
def entity_stats(spark, d):
    return en.entity_stats(en.entity_rows(_found(spark, d), "doc_id"), "doc_id")


LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ed.TYPES.items()) + " END"


@query("highlight_spans", f"""{FOUND}, w AS (SELECT f.*, docs.text AS whole, coalesce(lag(f."end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before_ FROM found f JOIN docs USING (doc_id)),
b AS (SELECT doc_id, max("end") AS last, string_agg(substr(whole, before_ + 1, start - before_) || '<span class="entity-highlight entity-' || lower(type) || '" title="' || {LABEL} || ': '
  || round_even(confidence * 100, 0)::INTEGER || '%">' || text || '<sub>' || {LABEL} || '</sub></span>', '' ORDER BY start) AS body FROM w GROUP BY ALL)
SELECT doc_id, coalesce(body || substr(text, last + 1), text) AS markup FROM docs LEFT JOIN b USING (doc_id)""")
def highlight_spans(spark, d):
    rows = _found(spark, d)
    return rows.select("doc_id", en.highlight(rows).alias("markup"))


@query("entity_hit_rate", f"""{FOUND}, wanted AS (SELECT doc_id, unnest(['TIME', 'LOC', 'NOUN', 'PER', 'ORG']) AS type,
  unnest(['2024-01-1', '北京市', 'Python', '王小明', 'Google Inc']) AS text FROM documents),
h AS (SELECT w.*, EXISTS (SELECT 1 FROM found a WHERE a.doc_id = w.doc_id AND a.type = w.type AND (contains(a.text, w.text) OR contains(w.text, a.text))) AS hit FROM wanted w)
SELECT doc_id, count(*) FILTER (hit) AS hits, count(*) AS expected, round((count(*) FILTER (hit))::DOUBLE / count(*), 6) AS rate FROM h GROUP BY ROLLUP (doc_id)""")
def entity_hit_rate(spark, d):
    wanted = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(x).alias("text")) for t, x in (
        ("TIME", "2024-01-1"), ("LOC", "北京市"), ("NOUN", "Python"), ("PER", "王小明"), ("ORG", "Google Inc"))])
    cases = table(spark, d, "documents").select("doc_id", F.explode(wanted).alias("w")).select("doc_id", "w.*")
    return en.hit_rate(cases, en.entity_rows(_found(spark, d), "doc_id"), "doc_id").withColumn("rate", F.round("rate", 6))
