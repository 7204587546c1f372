"""NULL keys, NULL times, equal times and empty tables in place of defaults."""

import itertools

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import entities as en
from tessella.operators import habits, ordered, social
from tessella.operators import rooms as rm
from tessella.operators import sentiment as se
from tessella.sources import exports


@pytest.fixture(scope="module")
def events(spark):
    rows = [(k, r, t, v) for k, (r, t, v) in enumerate(itertools.product(
        ["a", None, "b"], [None, "2024-01-01 10:10:00", "2024-01-01 10:50:00", "2024-01-01 12:00:00"], [1, 2]))]
    return spark.createDataFrame(rows, "event_id int, room string, t string, v int").withColumn("ts", F.to_timestamp("t"))


def test_ordered_equals_the_plain_window(events):
    w = Window.partitionBy("room").orderBy("ts", "event_id")
    hour = F.date_trunc("hour", "ts")
    order = ["ts", "event_id"]
    plain = events.select("event_id", F.row_number().over(w).cast("long").alias("x"))
    assert sorted(ordered.sequence_in_key(events, ["room"], hour, order).select("event_id", "seq").collect()) == sorted(plain.collect())
    plain = events.select("event_id", F.sum("v").over(w).alias("x"))
    got = ordered.running_sum_in_key(events, ["room"], hour, order, F.col("v"), "s").select("event_id", "s")
    assert sorted(got.collect()) == sorted(plain.collect())
    plain = events.select("event_id", F.lag("event_id").over(w).alias("x"))
    got = ordered.previous_in_key(events, ["room"], hour, order, ["event_id"]).select("event_id", "prev.event_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_voice_without_targets_and_with_names(spark):
    rows = [(1, "r", "ann", "join", None, None), (2, "r", "bob", "join", None, None), (3, "r", "bob", "mute", None, True),
            (4, "r", "bob", "mute_all", None, True), (5, "r", "ann", "mute", "bob", False), (6, "r", "ann", "mute", None, None),
            (7, "r", "ann", "leave", None, None), (8, None, "cy", "join", None, None)]
    df = spark.createDataFrame(rows, "event_id int, room string, user_id string, kind string, target_id string, flag boolean")
    log, final = rm.voice_log(df.withColumn("ts", F.timestamp_seconds("event_id")))
    got = {r.event_id: (r.outcome, r.admin_id, r.members, r.muted) for r in log.collect()}
    assert got == {1: ("ok", "ann", 1, 0), 2: ("ok", "ann", 2, 0), 3: ("ok", "ann", 2, 1), 4: ("not admin", "ann", 2, 1),
                   5: ("ok", "ann", 2, 0), 6: ("ok", "ann", 2, 0), 7: ("ok", "bob", 1, 0), 8: ("ok", "cy", 1, 0)}
    assert {(r.room, r.user_id, r.muted) for r in final.collect()} == {("r", "bob", False), (None, "cy", False)}


def test_layers_without_numbers(spark):
    rows = [(1, "r", "add", "x", None), (2, "r", "toggle", "x", None), (3, "r", "move", "x", None), (4, "r", "move", "x", 0),
            (5, "r", "toggle", None, 1)]
    df = spark.createDataFrame(rows, "event_id int, room string, kind string, layer_id string, n int")
    got = {r.event_id: r.layers for r in rm.layer_state(df.withColumn("ts", F.timestamp_seconds("event_id"))).collect()}
    assert got == {1: "base+,x+", 2: "base+,x+", 3: "base+,x+", 4: "x+,base+", 5: "x+,base+"}


def both_ways(spark, rows, schema, use):
    return [sorted(map(tuple, use(spark.createDataFrame(r, schema).coalesce(1)).collect())) for r in (rows, rows[::-1])]


def test_equal_times_have_one_answer(spark):
    a, b = both_ways(spark, [(1, 1, "d", 9, "b", 5), (1, 1, "d", 7, "c", 5), (1, 1, "d", 8, "a", 5)],
                     "habit_id int, user_id int, date string, checkin_id int, type string, created_at int", habits.one_per_day)
    assert a == b == [(1, 1, "d", 7, "c", 5)]
    a, b = both_ways(spark, [(1, 1, True, 5), (1, 1, False, 5)], "post_id int, user_id int, liked boolean, ts int", social.likes)
    assert a == b == [(1, 1)]
    a, b = both_ways(spark, [(1, 2, "accepted", 5), (1, 2, "removed", 5)], "user_id int, friend_id int, status string, ts int",
                     social.friends)
    assert a == b
    schema = "path string, body string, updated_at int"
    old = spark.createDataFrame([("p", "old", 5)], schema)
    a, b = both_ways(spark, [("p", "n1", 5), ("p", "n2", 5)], schema, lambda new: exports.upsert_documents(old, new))
    assert a == b == [("p", "n2", 5)]


def test_empty_tables_stay_empty(spark):
    docs = spark.createDataFrame([(1, "昨天在北京 happy 好")], "doc_id int, text string")
    none = spark.createDataFrame([], "name string, type string, confidence double")
    assert en.gazetteer_entities(docs, "doc_id", none).count() == 0
    assert docs.select(F.size(en.gazetteer_spans(F.col("text"), []))).first()[0] == 0
    assert se.lexicon_matches(docs, "doc_id", []).count() == 0
    assert docs.select(se.lexicon_score(F.col("text"), F.lit("chinese"), [])).first()[0] == 0
    assert docs.select(se.emoji_score(F.lit("🙂"), [])).first()[0] == 0


def test_many_names(spark):
    names = spark.createDataFrame([(f"name{k:05d}", "ORG", 0.9) for k in range(25_000)], "name string, type string, confidence double")
    docs = spark.createDataFrame([(1, "x name00007 and name24999.")], "doc_id int, text string")
    got = {(r.start, r.text) for r in en.gazetteer_entities(docs, "doc_id", names).collect()}
    assert got == {(2, "name00007"), (16, "name24999")}
