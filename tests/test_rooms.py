"""State machines in rounds equal one replay; bucketed windows equal plain ones."""

import datetime
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import ordered, rooms, scan, undo
from tessella.streaming import rooms as st


def _events(spark, kinds, n=300, seed=3):
    rng = random.Random(seed)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=11 * i), 0 if rng.random() < 0.7 else 1, rng.randint(1, 15),
             rng.choice(kinds), rng.randint(1, 15), rng.random() < 0.5) for i in range(n)]
    return rows, spark.createDataFrame(
        rows, "event_id long, ts timestamp, room long, user_id long, kind string, target_id long, flag boolean")


def test_undo_in_rounds(spark):
    rows, df = _events(spark, ["draw", "draw", "undo", "undo", "redo"])
    want = set()
    for room in (0, 1):
        done, undone = [], []
        for r in (r for r in rows if r[2] == room):
            if r[4] == "draw":
                done, undone = done + [r[0]], []
            elif r[4] == "undo" and done:
                undone.append(done.pop())
            elif r[4] == "redo" and undone:
                done.append(undone.pop())
        want |= {(room, x) for x in done}
    for chunk in (50_000, 90):
        got = {tuple(r) for r in rooms.visible_commands(df, chunk).collect()}
        assert got == want


def test_pointer_in_blocks_with_null_rooms_and_one_hot_room(spark):
    rows, df = _events(spark, ["draw", "undo", "undo", "redo"], 700, 8)
    df = df.withColumn("room", F.when(F.col("room") == 0, 1))  # nine in ten events are of one room, the rest of none
    want, at, length = set(), {}, {}
    for r in rows:
        room = 1 if r[2] == 0 else None
        p, n = at.get(room, 0), length.get(room, 0)
        if r[4] == "draw":
            p = n = n + 1
        p = max(p - 1, 0) if r[4] == "undo" else min(p + 1, n) if r[4] == "redo" else p
        at[room], length[room] = p, n
        want.add((room, r[0], p))
    for block in (4096, 64, 4):
        assert {tuple(r) for r in rooms.undo_pointer(df, block).collect()} == want
    assert rooms.undo_pointer(df.limit(0)).count() == rooms.visible_commands(df.limit(0)).count() == 0


def test_a_hot_room_is_dealt_over_blocks(spark):
    """No group of rows is larger than a block, whatever its room holds."""
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.expr(
        "IF(id % 10 = 0, id % 7, 9)").alias("room"), F.expr("element_at(array('draw', 'undo', 'redo'), int(id * 7919 % 3 + 1))").alias("kind"))
    sizes = []

    class Counting(undo.History):
        def summary(self, events):
            assert len(events["kind"]) <= 256
            return super().summary(events)
    rows = ordered.sequence_in_key(df, ["room"], rooms.hour(), ["ts"], "place").withColumn("place", F.col("place") - 1)
    got = scan.scan(rows, "room", "place", ["kind"], Counting(True), ["event_id"], 256).orderBy("event_id").collect()
    at, length = {}, {}
    for r in df.orderBy("event_id").collect():
        p, n = at.get(r["room"], 0), length.get(r["room"], 0)
        n += r["kind"] == "draw"
        p = n if r["kind"] == "draw" else max(p - 1, 0) if r["kind"] == "undo" else min(p + 1, n)
        at[r["room"]], length[r["room"]] = p, n
        sizes.append(p)
    assert [r["depth"] for r in got] == sizes


def test_histories_compose():
    """Summaries of any cut, nested or not, act on any state as a replay does."""
    rng = random.Random(1)
    for t in range(3000):
        machine = undo.History(t % 2 == 0)
        events = rng.choices(["draw", "undo", "redo", None], rng.choice([(1, 1, 1, 0), (1, 8, 6, 0), (3, 2, 1, 1), (0, 5, 4, 0)]),
                             k=rng.randint(1, 60))
        cuts = sorted(rng.randint(0, len(events)) for _ in range(4))
        parts = [machine.summary({"kind": events[a:b]}) for a, b in zip([0, *cuts], [*cuts, len(events)])]
        depth = rng.randint(0, 30)
        state = [depth, depth + rng.randint(0, 6)]
        end = machine.emit({"kind": events}, state)[0][-1]
        for made in (machine.combine(parts), machine.combine([machine.combine(parts[:2]), machine.combine(parts[2:])])):
            assert machine.apply(made, state)[0] == end


def test_ordered_shuffles_rows_once(spark):
    """Besides the rows' one exchange there are only those of the table of buckets."""
    _, df = _events(spark, ["a"], 50)
    plan = ordered.sequence_in_key(df, ["room"], rooms.hour(), ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_g") == 2 and "coalesce" not in plan.split("Window")[0]


def test_voice_rounds_agree_and_keep_the_rules(spark):
    _, df = _events(spark, ["join", "join", "join", "leave", "mute", "mute_all"])
    whole = {tuple(r) for r in rooms.voice_log(df)[0].collect()}
    parts = {tuple(r) for r in rooms.voice_log(df, 70)[0].collect()}
    assert whole == parts
    for _, _, outcome, admin, members, muted in whole:
        assert members <= rooms.MAX_SPEAKERS and muted <= members
        assert (admin is None) == (members == 0)
        assert outcome in {"ok", "full", "not admin", "no target", "no session"}


def test_buckets_equal_plain_windows(spark):
    _, df = _events(spark, ["a"], 400)
    plain = Window.partitionBy("room").orderBy("ts")
    df = df.withColumns({"n": F.row_number().over(plain).cast("long"), "s": F.sum("target_id").over(plain),
                         "p": F.lag("event_id").over(plain)})
    out = ordered.sequence_in_key(df, ["room"], rooms.hour(), ["ts"])
    out = ordered.running_sum_in_key(out, ["room"], rooms.hour(), ["ts"], F.col("target_id"), "run")
    out = ordered.previous_in_key(out, ["room"], rooms.hour(), ["ts"], ["event_id"])
    bad = out.where("seq <> n OR run <> s OR NOT (prev.event_id <=> p)").count()
    assert bad == 0 and out.count() == 400


def test_bitrate(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(seconds=i), 1, *v) for i, v in enumerate(
        [(50.0, 5, 0), (50.0, 5, 0), (400.0, 5, 0), (150.0, 5, 5), (90.0, 60, 0)])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, rtt double, jitter int, lost int")
    got = [r["bitrate"] for r in rooms.bitrate_steps(df, 2).orderBy("event_id").collect()]
    assert got == [76800, 92160, 73728, 73728, 58982]


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    def write(name, minutes):
        rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), 1, "path")
                for i, m in enumerate(minutes)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, room long, command_type string").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
        del name
    schema = "event_id long, ts timestamp, room long, command_type string"
    for minutes in ([5, 30, 200], [10, 500]):  # the 10 arrives after its hour was closed
        write("x", minutes)
        st.run_available(st.windowed_activity(st.event_source(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"))
    got = {r["window_start"].hour: r["commands"] for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    assert got[0] == 2 and got[3] == 1


def _write_out_of_order(spark, df, path, parts=5):
    """Several files, each its own batch, rows shuffled over neighbouring files."""
    rows = sorted(df.collect(), key=lambda r: r["ts"])
    rng = random.Random(3)
    files = [[] for _ in range(parts)]
    for k, r in enumerate(rows):
        at = k * parts // len(rows)
        files[min(parts - 1, at + (k % (len(rows) // parts) > 0.8 * len(rows) / parts and rng.random() < 0.5))].append(r)
    for f in files:
        rng.shuffle(f)
        spark.createDataFrame(f, df.schema).coalesce(1).write.mode("append").parquet(path)
    assert any(a["ts"] > b["ts"] for f, g in zip(files, files[1:]) for a in f for b in g)


def test_streams_in_event_time_equal_batch(spark, tmp_path):
    """Late rows within the allowed lateness are put in order; the result is the batch result
    up to the last watermark."""
    _, df = _events(spark, ["draw", "draw", "undo", "undo", "redo"], 400)
    df = df.withColumn("x", F.col("event_id") * 1.5).withColumn("y", F.col("event_id") % 7).withColumn(
        "rtt", F.col("event_id") * 1.0).withColumn("jitter", F.lit(2)).withColumn("lost", F.col("event_id") % 3)
    path, late = str(tmp_path / "in"), "1500 minutes"
    _write_out_of_order(spark, df, path)
    source = lambda: st.event_source(spark, path, df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), files=1)
    last = df.agg(F.max("ts")).first()[0] - datetime.timedelta(minutes=1500)
    done = df.where(F.col("ts") <= F.lit(last))

    def both(stream, batch, name):
        st.run_available(stream, str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name / "data"))
        assert sorted(map(str, got.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
        return got
    both(st.numbered(source(), late), ordered.sequence_in_key(done, ["room"], rooms.hour(), ["ts", "event_id"], "sequence").select(
        "room", "event_id", "sequence"), "numbers")
    both(st.undo_pointer(source(), late), rooms.undo_pointer(done), "pointer")
    both(st.depths(source(), False, late), rooms.depths(done, False).select("room", "event_id", "kind", "place", "depth"), "depth")
    st.run_available(st.cursor_moves(source(), late), str(tmp_path / "moves"))
    moves = spark.read.parquet(str(tmp_path / "moves/data"))
    latest = moves.groupBy("room", "user_id").agg(F.max_by(F.struct("x", "y"), "n").alias("p")).select("room", "user_id", "p.x", "p.y")
    assert sorted(map(str, latest.collect())) == sorted(map(str, rooms.cursor_latest(done).collect()))
    whole = rooms.network_summary(df).where(F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last))
    both(st.network_summary(source(), late), whole, "network")


def test_rows_behind_the_watermark_are_dropped_not_put_in_between(spark, tmp_path):
    schema, t0 = "event_id long, ts timestamp, room long, kind string", datetime.datetime(2024, 1, 1)
    for rows in ([(1, 0, "draw"), (2, 50, "draw"), (3, 300, "draw")], [(4, 10, "undo"), (5, 310, "draw"), (6, 900, "draw")]):
        spark.createDataFrame([(i, t0 + datetime.timedelta(minutes=m), 1, k) for i, m, k in rows], schema).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
        source = st.event_source(spark, str(tmp_path / "in"), schema)
        st.run_available(st.numbered(source), str(tmp_path / "out"))
    got = {r["event_id"]: r["sequence"] for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 5: 4}


def test_waiting_rows_are_sorted_to_the_microsecond_in_blocks(spark, tmp_path):
    """Rows wait in more blocks than are sorted at once; those of one millisecond stand in order of time, not of id."""
    rng, t0 = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(seconds=rng.randint(0, 999), microseconds=rng.randint(0, 9)), i % 2) for i in range(2000)]
    schema = "event_id long, ts timestamp, room long"
    for some in (rows[:1200], rows[1200:] + [(5000, t0 + datetime.timedelta(hours=9), 0)]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    numbers = st.in_order(st.event_source(spark, str(tmp_path / "in"), schema, files=1), ["room"], [], 0,
                          lambda row, n: (n + 1, [(row[1], n + 1)]), "event_id long, sequence long", "1 hour", held=150, block=40)
    st.run_available(numbers, str(tmp_path / "out"))
    got = {(r["room"], r["sequence"]): r["event_id"] for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    want = {}
    for room in (0, 1):
        for n, r in enumerate(sorted((r for r in rows if r[2] == room), key=lambda r: (r[1], r[0])), 1):
            want[room, n] = r[0]
    assert got == want


def test_due_rows_come_a_block_at_a_time():
    """Of 3,000 rows that wait, no more than the blocks that overlap are read before the first come out."""
    class Waiting(dict):
        def keys(self):
            return iter(list(self))

        def updateValue(self, key, value):
            self[key] = value

        def getValue(self, key):
            return self[key]

        def removeKey(self, key):
            del self[key]

    class Value:
        body = None

        def exists(self):
            return self.body is not None

        def get(self):
            return self.body

        def update(self, body):
            self.body = body

        def clear(self):
            self.body = None

    class Handle:
        def getMapState(self, *a):
            return Waiting()

        def getValueState(self, *a):
            return Value()

        def registerTimer(self, at):
            self.at = at

        def deleteTimer(self, at):
            pass

    class Times:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at
    at = list(range(1, 3001))
    random.Random(1).shuffle(at)
    frame = pd.DataFrame({"event_id": at, "ts": pd.to_datetime(at, unit="ms")})
    machine = st.InOrder(pa.schema([("at", pa.int64()), ("event_id", pa.int64())]), 0, lambda row, n: (n + 1, [(row[1], n + 1)]),
                         ["event_id", "n"], held=1000, block=100)
    machine.init(Handle())
    machine.handleInputRows((1,), iter(frame[i:i + 250] for i in range(0, 3000, 250)), Times(0))
    assert len(machine.waiting) == 30 and machine.handle.at == 1
    out = []
    for given in machine.handleExpiredTimer((1,), Times(2500), None):
        if not out:
            assert len(machine.waiting) >= 25
        assert len(given) <= 100
        out += given["event_id"].tolist()
    assert out == list(range(1, 2501)) and machine.handle.at == 2501
    out = [x for given in machine.handleExpiredTimer((1,), Times(9000), None) for x in given["event_id"]]
    assert out == list(range(2501, 3001)) and not machine.waiting


def test_network_summary_counts_only_what_is_there(spark, tmp_path):
    """Missing round trips, jitters and users count neither in the means nor as peers, and a late row goes in while its hour is open."""
    schema, t0 = "event_id long, ts timestamp, room long, user_id long, rtt double, jitter long, lost long", datetime.datetime(2024, 1, 1)
    files = [[(1, 5, 1, 7, 10.0, 4, 1), (2, 6, 1, 7, None, 8, 0), (3, 7, 1, None, 30.0, None, None), (4, 50, 1, 8, 20.0, 3, 2), (5, 9, 2, 9, None, 1, 1)],
             [(6, 20, 1, 9, 40.0, 5, 1)], [(7, 300, 1, 7, 1.0, 1, 1)]]
    for rows in files:
        spark.createDataFrame([(i, t0 + datetime.timedelta(minutes=m), *r) for i, m, *r in rows], schema).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
        st.run_available(st.network_summary(st.event_source(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"))
    batch = rooms.network_summary(spark.read.schema(schema).parquet(str(tmp_path / "in")).where(f"ts < '{t0 + datetime.timedelta(hours=1)}'"))
    got = spark.read.parquet(str(tmp_path / "out/data")).select(*batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())) and got.count() == 2
    assert got.where("room = 1").first()["avg_rtt"] == 25.0 and got.where("room = 1").first()["peers"] == 3
