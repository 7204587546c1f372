"""Room events as Structured Streaming; each query has a batch twin."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from tessella.operators.undo import History


def event_source(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", files: int = 1000) -> DataFrame:
    """New Parquet files of a folder, `files` to a batch; on a cluster the same schema from Kafka."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)
            .withColumn("ts", F.col("ts").cast("timestamp")))


def windowed_activity(commands: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Emits a window once the watermark passes its end; later rows are dropped."""
    return (commands.withWatermark("ts", late).groupBy("room", "command_type", F.window("ts", every).alias("w"))
            .agg(F.count("*").alias("commands"))
            .select("room", "command_type", F.col("w.start").alias("window_start"), "commands"))


Step = Callable[[tuple, object], tuple[object, list[tuple]]]
"""(row, state) → (next state, what the row gives); states are values that JSON can hold."""


HELD_ROWS, BLOCK_ROWS = 500_000, 50_000
"""Rows that are sorted at once, and rows of a block of the state store."""


class InOrder(StatefulProcessor):
    """Rows of a key in order of (time, id), whatever files and batches bring them.

    A row waits in the state store until the watermark has passed its time, to the
    millisecond; a timer then takes all rows that are due and feeds them in order to
    the state machine. No row that is still accepted can come before them: the
    watermark holds for all keys, and rows at or before it are late and dropped. What
    waits is as much as arrives within the allowed lateness. It lies there as sorted
    blocks, named by their first time, and a block is read only when the rows before
    it are out: memory holds the blocks that overlap, not what waits."""

    def __init__(self, schema: pa.Schema, start: object, step: Step, out: list[str], held: int = HELD_ROWS, block: int = BLOCK_ROWS):
        self.schema, self.start, self.step, self.out, self.held, self.block = schema, start, step, out, held, block

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, place long", "rows binary")
        self.places = handle.getValueState("places", "n long")
        self.state = handle.getValueState("state", "body string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        new, firsts = [], []
        for part in rows:
            at = part["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            fresh = at // 1000 > passed
            new.append(pa.Table.from_pandas(part.assign(at=at)[fresh][self.schema.names], self.schema, preserve_index=False))
            if sum(map(len, new)) >= self.held:
                firsts.append(self.put(new))
                new = []
        if any(map(len, new)):
            firsts.append(self.put(new))
        if firsts:
            self.wake(min(firsts) // 1000)
        return iter([])

    def put(self, tables: list[pa.Table]) -> int:
        """Rows as sorted blocks; their first time."""
        rows = in_time(tables)
        place = self.places.get()[0] if self.places.exists() else 0
        for low in range(0, len(rows), self.block):
            block = rows.slice(low, self.block)
            body = pa.BufferOutputStream()
            with pa.ipc.new_stream(body, self.schema) as writer:
                writer.write_table(block)
            self.waiting.updateValue((block["at"][0].as_py(), place), (body.getvalue().to_pybytes(),))
            place += 1
        self.places.update((place,))
        return rows["at"][0].as_py()

    def take(self, block: tuple) -> pa.Table:
        rows = pa.ipc.open_stream(bytes(self.waiting.getValue(block)[0])).read_all()
        self.waiting.removeKey(block)
        return rows

    def due(self, passed: int) -> Iterator[pa.Table]:
        """The rows up to `passed` in order, at most a block at a time; later ones go on waiting."""
        blocks = sorted(tuple(k) for k in self.waiting.keys())
        later = [first for first, _ in blocks if first // 1000 > passed]
        blocks = blocks[:len(blocks) - len(later)]
        held: list[pa.Table] = []
        for i, block in enumerate(blocks):
            held.append(self.take(block))
            last = i + 1 == len(blocks)
            if not last and sum(map(len, held)) < self.block:
                continue
            rows = in_time(held)
            n = int(np.searchsorted(rows["at"].to_numpy(), (passed + 1) * 1000 if last else blocks[i + 1][0]))
            for low in range(0, n, self.block):
                yield rows.slice(low, min(self.block, n - low))
            held = [rows.slice(n)]
        if any(map(len, held)):
            later.append(self.put(held))
        if later:
            self.wake(min(later) // 1000)

    def wake(self, at: int) -> None:
        """One timer a key, at the first time that waits."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start
        for rows in self.due(timerValues.getCurrentWatermarkInMs()):
            out = []
            for row in zip(*[c.to_pylist() for c in rows.columns]):
                state, given = self.step(row, state)
                out += given
            if out:
                columns = [pd.Series(c) for c in zip(*out)]
                yield pd.DataFrame({**{f"_k{i}": [k] * len(out) for i, k in enumerate(key)}, **dict(zip(self.out, columns))})
        self.state.update((json.dumps(state),))

    def close(self) -> None:
        pass


def in_time(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).sort_by([("at", "ascending"), ("event_id", "ascending")]).combine_chunks()


def in_order(rows: DataFrame, keys: list[str], columns: list[str], start: object, step: Step, out: str,
             late: str = "10 minutes", held: int = HELD_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """keys and `out` (a schema) for what step makes of the rows (ts, event_id, columns) of
    each key, taken in order."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [f.split()[0] for f in out.split(", ")]
    waiting = to_arrow_schema(rows.select(F.lit(0).cast("long").alias("at"), "event_id", *columns).schema)
    machine = InOrder(waiting, start, step, names, held, block)
    found = (rows.withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(
        machine, ", ".join([f"_k{i} {kinds[k]}" for i, k in enumerate(keys)] + [out]), "Append", "EventTime"))
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *names)


def numbered(commands: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(room, event_id, sequence): the next number of the room."""
    return in_order(commands, ["room"], [], 0, lambda row, n: (n + 1, [(row[1], n + 1)]), "event_id long, sequence long", late)


def depths(events: DataFrame, log: bool, late: str = "10 minutes") -> DataFrame:
    """(room, event_id, kind, place, depth) after each event, as rooms.depths in batch."""
    machine = History(log)

    def step(row: tuple, state: list) -> tuple[list, list[tuple]]:
        _, event, kind = row
        depth = machine.emit({"kind": [kind]}, state[:2])[0][0]
        drawn = kind not in ("undo", "redo")
        top = depth if drawn else state[1]
        return [depth, top, state[2] + 1], [(event, kind, state[2], depth)]
    return in_order(events, ["room"], ["kind"], [0, 0, 0], step, "event_id long, kind string, place long, depth long", late)


def undo_pointer(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return depths(events, True, late).select("room", "event_id", F.col("depth").alias("pointer"))


def cursor_moves(moves: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(room, user_id, n, x, y): every position in order; the one of highest n is the latest."""
    return in_order(moves, ["room", "user_id"], ["x", "y"], 0,
                    lambda row, n: (n + 1, [(n + 1, row[2], row[3])]), "n long, x double, y long", late)


def network_summary(stats: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """As rooms.network_summary in batch, window by window. Distinct users are counted exactly: a first
    aggregate has a row per window and user, and a second one, which the same watermark closes, counts them."""
    users = stats.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "room", "user_id").agg(
        F.sum("rtt").alias("rtt"), F.count("rtt").alias("rtts"), F.sum("jitter").alias("jitter"), F.count("jitter").alias("jitters"),
        F.sum("lost").alias("lost"))
    return users.groupBy("w", "room").agg(
        (F.sum("rtt") / F.sum("rtts")).alias("avg_rtt"), (F.sum("jitter") / F.sum("jitters")).alias("avg_jitter"),
        F.sum("lost").alias("packets_lost"), F.count("user_id").alias("peers")).select(
        "room", F.col("w.start").alias("window_start"), "avg_rtt", "avg_jitter", "packets_lost", "peers")


def run_available(df: DataFrame, path: str, mode: str = "append") -> None:
    """Process what is there now into Parquet, with its own checkpoint."""
    (df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data")
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination())
