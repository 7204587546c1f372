"""Registered queries against their DuckDB check on the smallest tables.

A cross-section by default; TESSELLA_ALL=1 runs every query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

ROOT = "/root/testdata/sf0.001"
SAMPLE = """tfidf_keywords text_stats_en similarity_matrix tfidf_pairs current_streak badge_progress
makeup_decision note_components access_decision change_summary module_clusters snapshot_diff
action_plan target_collisions recommendations lexicon_score sentiment gazetteer_entities_join
time_entities visible_commands undo_pointer room_concurrency room_activity_stream envelope_decode
document_upsert""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TESSELLA_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, got) == rows(cols, cur.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
