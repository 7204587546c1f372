"""Room events in batch: validation, numbering, presence, voice, layers.

Numbering, changes and running counts use bucketed windows (see ordered). Undo and
redo are functions that compose, and are scanned over blocks (see scan and undo), so
one hot room is worked on by all tasks. The other state machines (voice sessions,
layers, bitrate) depend on every earlier event of their room; `fold` replays them in
rounds of a bounded number of events per room, hands a small state from round to round
and checkpoints it, so no task ever holds a whole hot room.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordered import previous_in_key, running_sum_in_key, sequence_in_key
from tessella.operators.scan import BLOCK, scan
from tessella.operators.undo import History
from tessella.session import cut

# Fixed values
COMMANDS = ["path", "line", "rect", "circle", "text", "erase"]
MAX_SPEAKERS, MAX_LAYERS, NAME_LENGTH, CODE_LENGTH = 10, 5, 20, 6
BITRATE_START, BITRATE_MIN, BITRATE_MAX, BITRATE_STEP = 64_000, 16_000, 128_000, 8_000

HOUR = "hour"


def hour(ts: str = "ts") -> Column:
    return F.date_trunc(HOUR, ts)


def valid_command() -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return (F.coalesce(F.col("command_type").isin(*COMMANDS), F.lit(False))
            & text("layer_id") & text("user_id") & text("user_name"))


def split_commands(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted commands and the rejected side output."""
    return commands.where(valid_command()), commands.where(~valid_command())


def command_sequence(commands: DataFrame) -> DataFrame:
    """max + 1 per room in order of arrival."""
    return sequence_in_key(commands, ["room"], hour(), ["ts", "event_id"], "sequence")


def presence(events: DataFrame) -> DataFrame:
    """Users whose latest event in a room is a join."""
    last = events.groupBy("room", "user_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))
    return last.where("kind = 'join'").select("room", "user_id")


def concurrency(events: DataFrame) -> DataFrame:
    """Online count after each change: joins of absent and leaves of present users."""
    rows = previous_in_key(events.where("kind IN ('join', 'leave')"), ["room", "user_id"], F.to_date("ts"),
                           ["ts", "event_id"], ["kind"])
    was_in = F.coalesce(F.col("prev.kind") == "join", F.lit(False))
    delta = (F.when((F.col("kind") == "join") & ~was_in, 1)
             .when((F.col("kind") == "leave") & was_in, -1).otherwise(0))
    rows = rows.withColumn("delta", delta).where("delta <> 0")
    return running_sum_in_key(rows, ["room"], hour(), ["ts", "event_id"], F.col("delta").cast("long"), "online")


def cursor_latest(moves: DataFrame) -> DataFrame:
    return moves.groupBy("room", "user_id").agg(
        F.max_by(F.struct("x", "y"), F.struct("ts", "event_id")).alias("p")).select("room", "user_id", "p.x", "p.y")


def clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring(F.trim(name), 1, NAME_LENGTH), "[<>]", ""))


def join_quality(requests: DataFrame, rooms: DataFrame) -> DataFrame:
    """(request_id, user_name, room_code) → cleaned values and outcome."""
    rows = requests.withColumns({"name": clean_name(F.coalesce("user_name", F.lit(""))),
                                 "code": F.upper(F.trim(F.coalesce("room_code", F.lit(""))))})
    known = rooms.select(F.col("room_code").alias("code"), F.lit(True).alias("known")).distinct()
    return rows.join(known, "code", "left").select("request_id", "name", "code", F.when(
        F.col("name") == "", "name missing").when(F.length("code") != CODE_LENGTH, "code malformed")
        .when(F.col("known").isNull(), "no such room").otherwise("ok").alias("outcome"))


def speaking_changes(events: DataFrame) -> DataFrame:
    """Only transitions; everybody starts silent."""
    rows = previous_in_key(events, ["room", "user_id"], F.to_date("ts"), ["ts", "event_id"], ["speaking"])
    return rows.where(F.col("speaking") != F.coalesce("prev.speaking", F.lit(False))).drop("prev")


def network_summary(stats: DataFrame, every: str = "1 hour") -> DataFrame:
    return stats.groupBy("room", F.window("ts", every).alias("w")).agg(
        F.avg("rtt").alias("avg_rtt"), F.avg("jitter").alias("avg_jitter"),
        F.sum("lost").alias("packets_lost"), F.countDistinct("user_id").alias("peers")).select(
        "room", F.col("w.start").alias("window_start"), "avg_rtt", "avg_jitter", "packets_lost", "peers")


def activity(commands: DataFrame, every: str, slide: str | None = None) -> DataFrame:
    """Commands per room and type in tumbling or sliding windows."""
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    return commands.groupBy("room", "command_type", w.alias("w")).agg(F.count("*").alias("commands")).select(
        "room", "command_type", F.col("w.start").alias("window_start"), "commands")


def sessions(commands: DataFrame, gap: str) -> DataFrame:
    """Bursts per room and user separated by silence."""
    return commands.groupBy("room", "user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("commands")).select("room", "user_id", F.col("w.start").alias("started"), "commands")


# ------------------------------------------------------------------ state machines

Step = Callable[[dict, pd.DataFrame], tuple[list[tuple], dict]]


def fold(events: DataFrame, key: str, order: list[str], columns: list[str], step: Step, schema: str,
         chunk: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Replay events per key in order. Returns the rows the step emits and the
    final (key, state JSON). Each round feeds at most `chunk` events per key."""
    rows = cut(sequence_in_key(events, [key], hour(), order, "_seq").select(key, "_seq", *columns))
    kind = dict(rows.dtypes)[key]
    longest = rows.agg(F.max("_seq")).first()[0] or 0
    names = [f.split()[0] for f in schema.split(", ")]
    out_schema = f"{key} {kind}, {schema}, _state string"

    def run(k: object, part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        state = json.loads(before["_state"].iloc[0]) if len(before) else {}
        emitted, state = step(state, part.sort_values("_seq"))
        data = [(k, *r, None) for r in emitted] + [(k, *[None] * len(names), json.dumps(state))]
        return pd.DataFrame(data, columns=[key, *names, "_state"]).astype(object)

    def first(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return run(k[0], part, part.iloc[:0].assign(_state=[]))

    def later(k: tuple, part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        return run(k[0], part, before)
    emitted, state = None, None
    for i in range(max(1, math.ceil(longest / chunk))):
        part = rows.where(F.floor((F.col("_seq") - 1) / chunk) == i).groupBy(key)
        done = cut(part.applyInPandas(first, out_schema) if state is None
                   else part.cogroup(state.groupBy(key)).applyInPandas(later, out_schema))
        new = done.where("_state IS NULL").drop("_state")
        emitted = new if emitted is None else emitted.unionByName(new)
        state = done.where("_state IS NOT NULL").select(key, "_state")
    return emitted, state.withColumnRenamed("_state", "state")


def _plain(value):
    """A cell as JSON holds it: NULL, also as NaN, is None, and a whole float an int."""
    if pd.isna(value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return int(value) if isinstance(value, float) and value.is_integer() else value


def depths(events: DataFrame, log: bool, block: int = BLOCK) -> DataFrame:
    """(room, event_id, kind, place, depth) after each event, see undo."""
    rows = sequence_in_key(events, ["room"], hour(), ["ts", "event_id"], "place").withColumn("place", F.col("place") - 1)
    return scan(rows, "room", "place", ["kind"], History(log), ["event_id", "kind", "place"], block)


def visible_commands(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(room, event_id) of the drawings left after all undo and redo: at each depth up to
    the last one, the latest drawing that was put there."""
    rows = cut(depths(events, False, block).withColumn("_room", F.struct("room")))
    last = rows.groupBy(F.col("_room").alias("_of")).agg(F.max_by("depth", "place").alias("_last"))
    drawn = rows.where("kind IS NULL OR kind NOT IN ('undo', 'redo')").groupBy("_room", "depth").agg(
        F.max_by("event_id", "place").alias("event_id"))
    return drawn.join(last, F.col("_room") == F.col("_of")).where("depth <= _last").select("_room.room", "event_id")


def undo_pointer(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """The shared pointer after each event, between 0 and the log length."""
    return depths(events, True, block).select("room", "event_id", F.col("depth").alias("pointer"))


def voice_step(state: dict, part: pd.DataFrame):
    """Members in order of joining, the administrator, who is muted."""
    members, admin, out = state.get("members", []), state.get("admin"), []
    muted = dict(state.get("muted", []))
    for event, user, kind, target, flag in zip(part["event_id"], part["user_id"], part["kind"],
                                               part["target_id"], part["flag"]):
        user, flag, result = _plain(user), bool(_plain(flag)), "ok"
        target = user if _plain(target) is None else _plain(target)
        if kind == "join":
            if len(members) >= MAX_SPEAKERS:
                result = "full"
            else:
                admin = user if admin is None else admin
                members += [] if user in members else [user]
                muted[user] = False
        elif kind == "leave":
            if user in members:
                members.remove(user)
                muted.pop(user, None)
                admin = (members[0] if members else None) if user == admin or not members else admin
        elif not members:
            result = "no session"
        elif kind == "mute_all":
            if user != admin:
                result = "not admin"
            else:
                muted.update({m: flag for m in members if m != admin})
        elif kind == "mute" and target != user:
            if user != admin:
                result = "not admin"
            elif target not in members:
                result = "no target"
            else:
                muted[target] = flag
        elif kind == "mute" and user in members:
            muted[user] = flag
        out.append((_plain(event), result, admin, len(members), sum(muted.values())))
    return out, {"members": members, "admin": admin, "muted": list(muted.items())}


def voice_log(events: DataFrame, chunk: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Per event its outcome, the administrator, members and muted members; and
    the final (room, user_id, muted) of those still present. User ids may be of any
    simple type; without a target one means oneself."""
    who = dict(events.dtypes)["user_id"]
    log, state = fold(events, "room", ["ts", "event_id"], ["event_id", "user_id", "kind", "target_id", "flag"],
                      voice_step, f"event_id long, outcome string, admin_id {who}, members long, muted long", chunk)
    pairs = F.from_json("state", "muted array<array<string>>")["muted"]
    final = state.select("room", F.explode(pairs).alias("p")).select(
        "room", F.col("p")[0].cast(who).alias("user_id"), (F.col("p")[1] == "true").alias("muted"))
    return log, final


def bitrate_step(state: dict, part: pd.DataFrame):
    rate, out = state.get("rate", BITRATE_START), []
    for event, rtt, jitter, lost in zip(part["event_id"], part["rtt"], part["jitter"], part["lost"]):
        wanted = rate
        if rtt > 300 or jitter > 50 or lost > 10:
            wanted = max(BITRATE_MIN, rate * 0.8)
        elif rtt < 100 and jitter < 20 and lost < 2:
            wanted = min(BITRATE_MAX, rate * 1.2)
        if abs(wanted - rate) > BITRATE_STEP:
            rate = math.floor(wanted + 0.5)
        out.append((int(event), rate))
    return out, {"rate": rate}


def bitrate_steps(stats: DataFrame, chunk: int = 50_000) -> DataFrame:
    return fold(stats, "user_id", ["ts", "event_id"], ["event_id", "rtt", "jitter", "lost"], bitrate_step,
                "event_id long, bitrate long", chunk)[0]


def layer_step(state: dict, part: pd.DataFrame):
    """Ordered layers with visibility; one to MAX_LAYERS of them."""
    layers, current, out = state.get("layers", [["base", True]]), state.get("current", "base"), []
    for event, kind, layer, n in zip(part["event_id"], part["kind"], part["layer_id"], part["n"]):
        ids, n = [x[0] for x in layers], _plain(n)
        if kind == "add" and len(layers) < MAX_LAYERS and layer not in ids:
            layers.append([layer, True])
            current = layer
        elif kind == "remove" and len(layers) > 1 and layer in ids:
            i = ids.index(layer)
            layers.pop(i)
            current = layers[max(0, i - 1)][0] if current == layer else current
        elif kind == "toggle" and layer in ids and n is not None:
            layers[ids.index(layer)][1] = n % 2 == 0
        elif kind == "move" and layer in ids and n is not None and 0 <= n < len(layers):
            layers.insert(n, layers.pop(ids.index(layer)))
        elif kind == "select" and layer in ids:
            current = layer
        shown = ",".join(f"{x}{'+' if v else '-'}" for x, v in layers)
        out.append((_plain(event), shown, current))
    return out, {"layers": layers, "current": current}


def layer_state(events: DataFrame, chunk: int = 50_000) -> DataFrame:
    return fold(events, "room", ["ts", "event_id"], ["event_id", "kind", "layer_id", "n"], layer_step,
                "event_id long, layers string, current string", chunk)[0]
