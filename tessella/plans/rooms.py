"""Room queries over events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import rooms as rm
from tessella.plans.habits import _scratch
from tessella.plans.registry import query
from tessella.sources.tables import table
from tessella.streaming import rooms as st

CMD = {"click": "path", "view": "line", "signup": "text", "purchase": "rect", "error": "blob"}
CASE = "CASE event_type WHEN 'click' THEN {0} WHEN 'view' THEN {1} WHEN 'signup' THEN {2} WHEN 'purchase' THEN {3} ELSE {4} END"
COMMAND = CASE.format(*[f"'{v}'" for v in CMD.values()])
LAYER = "CASE WHEN event_id % 23 = 0 THEN '' ELSE concat('layer_', event_id % 5) END"
EV = f"ev AS (SELECT event_id, ts, user_id, user_id % 10 AS room, event_type, value, {COMMAND} AS command_type, {LAYER} AS layer_id FROM events)"
OK = "command_type <> 'blob' AND layer_id <> ''"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _events(spark, d, *extra):
    ev = table(spark, d, "events").withColumn("room", F.col("user_id") % 10)
    return ev.select("event_id", "ts", "user_id", "room", "event_type", "value", *extra)


def _commands(spark, d):
    return _events(spark, d, F.expr(COMMAND).alias("command_type"), F.expr(LAYER).alias("layer_id"),
                   F.concat(F.lit("user "), F.col("user_id")).alias("user_name"))


def _kinds(spark, d, *kinds):
    return _events(spark, d, F.expr(CASE.format(*[f"'{k}'" for k in kinds])).alias("kind"))


def _stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("command_validate", f"WITH {EV} SELECT event_id, {OK} AS accepted FROM ev")
def command_validate(spark, d):
    good, bad = rm.split_commands(_commands(spark, d))
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(
        bad.select("event_id", F.lit(False).alias("accepted")))


SEQ = f"WITH {EV} SELECT room, event_id, row_number() OVER (PARTITION BY room ORDER BY ts, event_id) AS sequence FROM ev WHERE {OK}"


@query("command_sequence", SEQ)
def command_sequence(spark, d):
    return rm.command_sequence(rm.split_commands(_commands(spark, d))[0]).select("room", "event_id", "sequence")


@query("command_replay", f"SELECT room, sequence, command_type, s.event_id, user_id FROM ({SEQ}) s JOIN (WITH {EV} SELECT event_id, user_id, command_type FROM ev) USING (event_id)")
def command_replay(spark, d):
    return rm.command_sequence(rm.split_commands(_commands(spark, d))[0]).select(
        "room", "sequence", "command_type", "event_id", "user_id").orderBy("room", "sequence")


STACK = ("draw", "draw", "undo", "redo", "undo")
NUM = f"""k AS (SELECT user_id % 10 AS room, event_id, {CASE.format(*[f"'{x}'" for x in STACK])} AS kind,
  row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events)"""


@query("visible_commands", f"""WITH RECURSIVE {NUM}, f AS (
SELECT DISTINCT room, 0::BIGINT AS n, []::BIGINT[] AS done, []::BIGINT[] AS redo FROM k
UNION ALL SELECT f.room, k.n, CASE kind WHEN 'draw' THEN list_append(done, event_id) WHEN 'undo' THEN done[1:len(done) - 1]
    ELSE CASE WHEN len(redo) > 0 THEN list_append(done, redo[len(redo)]) ELSE done END END,
  CASE kind WHEN 'draw' THEN [] WHEN 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(redo, done[len(done)]) ELSE redo END
    ELSE redo[1:len(redo) - 1] END
FROM f JOIN k ON k.room = f.room AND k.n = f.n + 1)
SELECT room, unnest(done) AS event_id FROM f WHERE (room, n) IN (SELECT (room, max(n)) FROM k GROUP BY room)""")
def visible_commands(spark, d):
    return rm.visible_commands(_kinds(spark, d, *STACK))


POINTER = f"""{NUM}, f AS (
SELECT DISTINCT room, 0::BIGINT AS n, 0::BIGINT AS event_id, 0::BIGINT AS p, 0::BIGINT AS len FROM k
UNION ALL SELECT f.room, k.n, k.event_id, CASE kind WHEN 'draw' THEN len + 1 WHEN 'undo' THEN greatest(p - 1, 0) ELSE least(p + 1, len) END,
  CASE kind WHEN 'draw' THEN len + 1 ELSE len END FROM f JOIN k ON k.room = f.room AND k.n = f.n + 1)"""


@query("undo_pointer", f"WITH RECURSIVE {POINTER} SELECT room, event_id, p AS pointer FROM f WHERE n > 0")
def undo_pointer(spark, d):
    return rm.undo_pointer(_kinds(spark, d, *STACK))


JOINS = ("join", "join", "leave", "cursor", "leave")
J = f"j AS (SELECT user_id % 10 AS room, user_id, ts, event_id, value, {CASE.format(*[f'{chr(39)}{x}{chr(39)}' for x in JOINS])} AS kind FROM events)"


@query("room_presence", f"""WITH {J} SELECT room, user_id FROM (SELECT room, user_id, arg_max(kind, ts) AS kind FROM j WHERE kind <> 'cursor' GROUP BY ALL) WHERE kind = 'join'""")
def room_presence(spark, d):
    return rm.presence(_kinds(spark, d, *JOINS).where("kind <> 'cursor'"))


@query("room_concurrency", f"""WITH {J}, p AS (SELECT *, lag(kind) OVER (PARTITION BY room, user_id ORDER BY ts, event_id) AS was FROM j WHERE kind <> 'cursor'),
x AS (SELECT *, CASE WHEN kind = 'join' AND coalesce(was, '') <> 'join' THEN 1 WHEN kind = 'leave' AND was = 'join' THEN -1 ELSE 0 END AS delta FROM p)
SELECT room, event_id, sum(delta) OVER (PARTITION BY room ORDER BY ts, event_id)::BIGINT AS online FROM x WHERE delta <> 0""")
def room_concurrency(spark, d):
    return rm.concurrency(_kinds(spark, d, *JOINS)).select("room", "event_id", "online")


@query("cursor_latest", f"""WITH {J} SELECT room, user_id, arg_max(value, ts) AS x, arg_max(event_id % 1080, ts) AS y FROM j GROUP BY ALL""")
def cursor_latest(spark, d):
    return rm.cursor_latest(_events(spark, d).withColumns({"x": F.col("value"), "y": F.col("event_id") % 1080}))


@query("join_quality", """WITH r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 = 0 THEN ' <> ' ELSE ' <b>' || c_name || '-' || c_mktsegment END AS u,
  ' room' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lpad((c_custkey % 60)::VARCHAR, 2, '0') END AS c FROM customer),
x AS (SELECT request_id, trim(regexp_replace(substr(trim(u), 1, 20), '[<>]', '', 'g')) AS name, upper(trim(c)) AS code FROM r)
SELECT request_id, name, code, CASE WHEN name = '' THEN 'name missing' WHEN length(code) <> 6 THEN 'code malformed'
  WHEN code NOT IN (SELECT 'ROOM' || lpad(s_suppkey::VARCHAR, 2, '0') FROM supplier WHERE s_suppkey < 40) THEN 'no such room' ELSE 'ok' END AS outcome FROM x""")
def join_quality(spark, d):
    req = table(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN ' <> ' ELSE concat(' <b>', c_name, '-', c_mktsegment) END").alias("user_name"),
        F.expr("concat(' room', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lpad(string(c_custkey % 60), 2, '0') END)").alias("room_code"))
    rooms = table(spark, d, "supplier").where("s_suppkey < 40").select(
        F.expr("concat('ROOM', lpad(string(s_suppkey), 2, '0'))").alias("room_code"))
    return rm.join_quality(req, rooms)


VOICE = ("join", "leave", "mute", "mute_all", "join")


def _voice(spark, d):
    return _kinds(spark, d, *VOICE).withColumns({
        "target_id": F.when(F.col("event_id") % 2 == 0, F.col("user_id")).otherwise((F.col("user_id") + 10) % 150),
        "flag": F.col("event_id") % 3 != 0})


TALK = f"""k AS (SELECT user_id % 10 AS room, user_id, event_id, {CASE.format(*[f"'{x}'" for x in VOICE])} AS kind,
  CASE WHEN event_id % 2 = 0 THEN user_id ELSE (user_id + 10) % 150 END AS target, event_id % 3 <> 0 AS flag,
  row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT DISTINCT room, 0::BIGINT AS n, 0::BIGINT AS event_id, []::BIGINT[] AS m, NULL::BIGINT AS admin, []::BIGINT[] AS quiet, 'ok' AS outcome FROM k
UNION ALL SELECT f.room, k.n, k.event_id,
  CASE WHEN kind = 'join' AND len(m) < 10 AND NOT list_contains(m, user_id) THEN list_append(m, user_id)
    WHEN kind = 'leave' THEN list_filter(m, lambda x: x <> user_id) ELSE m END,
  CASE WHEN kind = 'join' AND len(m) < 10 THEN coalesce(admin, user_id)
    WHEN kind = 'leave' AND user_id = admin THEN list_filter(m, lambda x: x <> user_id)[1] ELSE admin END,
  CASE WHEN kind = 'leave' OR kind = 'join' AND len(m) < 10 THEN list_filter(quiet, lambda x: x <> user_id)
    WHEN kind = 'mute_all' AND user_id = admin THEN list_concat(list_filter(quiet, lambda x: x = user_id), CASE WHEN flag THEN list_filter(m, lambda x: x <> user_id) ELSE [] END)
    WHEN kind = 'mute' AND list_contains(m, target) AND (user_id = admin OR target = user_id) THEN
      list_concat(list_filter(quiet, lambda x: x <> target), CASE WHEN flag THEN [target] ELSE [] END) ELSE quiet END,
  CASE WHEN kind = 'join' AND len(m) >= 10 THEN 'full' WHEN kind IN ('join', 'leave') THEN 'ok' WHEN len(m) = 0 THEN 'no session'
    WHEN user_id IS DISTINCT FROM admin AND (kind = 'mute_all' OR target <> user_id) THEN 'not admin'
    WHEN kind = 'mute' AND target <> user_id AND NOT list_contains(m, target) THEN 'no target' ELSE 'ok' END
FROM f JOIN k ON k.room = f.room AND k.n = f.n + 1)"""


@query("voice_admin", f"WITH RECURSIVE {TALK} SELECT room, event_id, admin AS admin_id, len(m) AS members FROM f WHERE n > 0")
def voice_admin(spark, d):
    return rm.voice_log(_voice(spark, d))[0].select("room", "event_id", "admin_id", "members")


@query("voice_capacity", f"WITH RECURSIVE {TALK} SELECT room, event_id, len(m) AS members FROM f WHERE n > 0 AND outcome = 'full'")
def voice_capacity(spark, d):
    return rm.voice_log(_voice(spark, d))[0].where("outcome = 'full'").select("room", "event_id", "members")


@query("mute_state", f"""WITH RECURSIVE {TALK}, z AS (SELECT *, unnest(m) AS user_id FROM f WHERE (room, n) IN (SELECT (room, max(n)) FROM k GROUP BY room))
SELECT room, user_id, list_contains(quiet, user_id) AS muted FROM z""")
def mute_state(spark, d):
    return rm.voice_log(_voice(spark, d))[1]


@query("speaking_changes", """WITH s AS (SELECT user_id % 10 AS room, user_id, event_id, value > 30 AS speaking, lag(value > 30) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT room, user_id, event_id, speaking FROM s WHERE speaking <> coalesce(was, FALSE)""")
def speaking_changes(spark, d):
    rows = _events(spark, d).withColumn("speaking", F.col("value") > 30)
    return rm.speaking_changes(rows).select("room", "user_id", "event_id", "speaking")


def _stats(spark, d):
    return _events(spark, d).withColumns({"rtt": F.col("value") * 3, "jitter": F.col("event_id") % 60,
                                          "lost": F.col("event_id") % 13})


@query("network_summary", f"""SELECT user_id % 10 AS room, {TS.format("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, round(avg(value * 3), 6) AS avg_rtt,
round(avg(event_id % 60), 6) AS avg_jitter, sum(event_id % 13)::BIGINT AS packets_lost, count(DISTINCT user_id) AS peers FROM events GROUP BY ALL""")
def network_summary(spark, d):
    return rm.network_summary(_stats(spark, d)).select(
        "room", _stamp("window_start"), F.round("avg_rtt", 6).alias("avg_rtt"), F.round("avg_jitter", 6).alias("avg_jitter"),
        "packets_lost", "peers")


RATES = """k AS (SELECT user_id, event_id, value * 3 AS rtt, event_id % 60 AS jitter, event_id % 13 AS lost,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, 64000::BIGINT AS rate FROM k
UNION ALL SELECT user_id, n, event_id, CASE WHEN abs(wanted - rate) > 8000 THEN floor(wanted + 0.5)::BIGINT ELSE rate END
FROM (SELECT f.user_id, k.n, k.event_id, rate, CASE WHEN rtt > 300 OR jitter > 50 OR lost > 10 THEN greatest(16000::DOUBLE, rate * 0.8::DOUBLE)
    WHEN rtt < 100 AND jitter < 20 AND lost < 2 THEN least(128000::DOUBLE, rate * 1.2::DOUBLE) ELSE rate::DOUBLE END AS wanted
  FROM f JOIN k ON k.user_id = f.user_id AND k.n = f.n + 1))"""


@query("bitrate_steps", f"WITH RECURSIVE {RATES} SELECT user_id, event_id, rate AS bitrate FROM f WHERE n > 0")
def bitrate_steps(spark, d):
    return rm.bitrate_steps(_stats(spark, d))


LAYERS = ("add", "remove", "toggle", "move", "select")
STACKED = f"""k AS (SELECT user_id % 10 AS room, event_id, {CASE.format(*[f"'{x}'" for x in LAYERS])} AS kind, 'l' || event_id % 8 AS l, event_id % 5 AS pos,
  row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT DISTINCT room, 0::BIGINT AS n, 0::BIGINT AS event_id, ['base'] AS ids, []::VARCHAR[] AS hidden, 'base' AS current FROM k
UNION ALL SELECT f.room, k.n, k.event_id,
  CASE WHEN kind = 'add' AND len(ids) < 5 AND NOT list_contains(ids, l) THEN list_append(ids, l)
    WHEN kind = 'remove' AND len(ids) > 1 THEN list_filter(ids, lambda x: x <> l)
    WHEN kind = 'move' AND list_contains(ids, l) AND pos < len(ids) THEN list_concat(list_append(list_filter(ids, lambda x: x <> l)[1:pos], l),
      list_filter(ids, lambda x: x <> l)[pos + 1:]) ELSE ids END,
  CASE WHEN kind = 'remove' AND len(ids) > 1 THEN list_filter(hidden, lambda x: x <> l)
    WHEN kind = 'toggle' AND list_contains(ids, l) THEN list_concat(list_filter(hidden, lambda x: x <> l), CASE WHEN pos % 2 = 0 THEN [] ELSE [l] END)
    ELSE hidden END,
  CASE WHEN kind = 'add' AND len(ids) < 5 AND NOT list_contains(ids, l) OR kind = 'select' AND list_contains(ids, l) THEN l
    WHEN kind = 'remove' AND len(ids) > 1 AND current = l THEN list_filter(ids, lambda x: x <> l)[greatest(list_position(ids, l) - 2, 0) + 1]
    ELSE current END
FROM f JOIN k ON k.room = f.room AND k.n = f.n + 1)"""


@query("layer_state", f"""WITH RECURSIVE {STACKED} SELECT room, event_id,
  array_to_string(list_transform(ids, lambda x: x || CASE WHEN list_contains(hidden, x) THEN '-' ELSE '+' END), ',') AS layers, current FROM f WHERE n > 0""")
def layer_state(spark, d):
    rows = _kinds(spark, d, *LAYERS)
    return rm.layer_state(rows.withColumns({
        "layer_id": F.concat(F.lit("l"), F.col("event_id") % 8), "n": F.col("event_id") % 5}))


@query("room_activity", f"""WITH {EV} SELECT room, command_type, {TS.format("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, count(*) AS commands FROM ev GROUP BY ALL""")
def room_activity(spark, d):
    return rm.activity(_commands(spark, d), "1 hour").withColumn("window_start", _stamp("window_start"))


@query("room_activity_sliding", f"""WITH {EV}, w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(i AS INTEGER)) AS window_start FROM ev, range(2) t(i))
SELECT room, command_type, {TS.format("window_start")} AS window_start, count(*) AS commands FROM w GROUP BY ALL""")
def room_activity_sliding(spark, d):
    return rm.activity(_commands(spark, d), "2 hours", "1 hour").withColumn("window_start", _stamp("window_start"))


@query("room_sessions", f"""WITH {EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY room, user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM ev),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY room, user_id ORDER BY ts) AS sid FROM g)
SELECT room, user_id, {TS.format("min(ts)")} AS started, count(*) AS commands FROM s GROUP BY room, user_id, sid""")
def room_sessions(spark, d):
    return rm.sessions(_commands(spark, d), "6 hours").withColumn("started", _stamp("started"))


STREAM_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, d):
    ev = st.event_source(spark, d, STREAM_SCHEMA, "events.parquet")
    return ev.select("event_id", "ts", "user_id", (F.col("user_id") % 10).alias("room"),
                     F.expr(COMMAND).alias("command_type"), F.expr(LAYER).alias("layer_id"),
                     F.concat(F.lit("user "), F.col("user_id")).alias("user_name"))


@query("command_stream_source", f"WITH {EV} SELECT event_id, room, {TS.format('ts')} AS ts, command_type, layer_id FROM ev")
def command_stream_source(spark, d):
    path = _scratch(spark, "commands")
    st.run_available(_stream(spark, d), path)
    return spark.read.parquet(f"{path}/data").select("event_id", "room", _stamp("ts"), "command_type", "layer_id")


@query("room_activity_stream", f"""WITH {EV}, w AS (SELECT room, command_type, time_bucket(INTERVAL 1 HOUR, ts) AS ws, count(*) AS commands FROM ev GROUP BY ALL)
SELECT room, command_type, {TS.format("ws")} AS window_start, commands FROM w WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def room_activity_stream(spark, d):
    path = _scratch(spark, "activity")
    st.run_available(st.windowed_activity(_stream(spark, d)), path)
    return spark.read.parquet(f"{path}/data").withColumn("window_start", _stamp("window_start"))


# A stream gives out what the watermark has passed: here all but the last ten minutes.
PASSED = "event_id IN (SELECT event_id FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))"


def _streamed(spark, stream, name):
    path = _scratch(spark, name)
    st.run_available(stream, path)
    return spark.read.parquet(f"{path}/data")


@query("command_sequence_stream", f"WITH s AS ({SEQ}) SELECT * FROM s WHERE {PASSED}")
def command_sequence_stream(spark, d):
    return _streamed(spark, st.numbered(_stream(spark, d).where(rm.valid_command())), "sequence")


def _kind_stream(spark, d, *kinds):
    ev = st.event_source(spark, d, STREAM_SCHEMA, "events.parquet")
    return ev.select("event_id", "ts", "user_id", (F.col("user_id") % 10).alias("room"),
                     F.expr(CASE.format(*[f"'{k}'" for k in kinds])).alias("kind"))


@query("undo_pointer_stream", f"""WITH RECURSIVE {POINTER}, p AS (SELECT room, event_id, p AS pointer FROM f WHERE n > 0) SELECT * FROM p WHERE {PASSED}""")
def undo_pointer_stream(spark, d):
    return _streamed(spark, st.undo_pointer(_kind_stream(spark, d, *STACK)), "pointer")


@query("cursor_latest_stream", f"""SELECT user_id % 10 AS room, user_id, arg_max(value, (ts, event_id)) AS x, arg_max(event_id % 1080, (ts, event_id)) AS y
FROM events WHERE {PASSED} GROUP BY ALL""")
def cursor_latest_stream(spark, d):
    ev = st.event_source(spark, d, STREAM_SCHEMA, "events.parquet")
    moves = ev.select("event_id", "ts", "user_id", (F.col("user_id") % 10).alias("room"), F.col("value").alias("x"),
                      (F.col("event_id") % 1080).alias("y"))
    found = _streamed(spark, st.cursor_moves(moves), "moves")
    return found.groupBy("room", "user_id").agg(F.max_by(F.struct("x", "y"), "n").alias("p")).select("room", "user_id", "p.x", "p.y")


@query("network_summary_stream", f"""WITH w AS (SELECT user_id % 10 AS room, time_bucket(INTERVAL 1 HOUR, ts) AS ws, avg(value * 3) AS rtt, avg(event_id % 60) AS jitter,
sum(event_id % 13)::BIGINT AS lost, count(DISTINCT user_id) AS peers FROM events GROUP BY ALL)
SELECT room, {TS.format('ws')} AS window_start, round(rtt, 6) AS avg_rtt, round(jitter, 6) AS avg_jitter, lost AS packets_lost, peers FROM w
WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def network_summary_stream(spark, d):
    ev = st.event_source(spark, d, STREAM_SCHEMA, "events.parquet")
    stats = ev.select("ts", "user_id", (F.col("user_id") % 10).alias("room"), (F.col("value") * 3).alias("rtt"),
                      (F.col("event_id") % 60).alias("jitter"), (F.col("event_id") % 13).alias("lost"))
    return _streamed(spark, st.network_summary(stats), "network").select(
        "room", _stamp("window_start"), F.round("avg_rtt", 6).alias("avg_rtt"), F.round("avg_jitter", 6).alias("avg_jitter"),
        "packets_lost", "peers")
