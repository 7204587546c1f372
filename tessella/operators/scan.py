"""Running states of keys that may be very hot: a parallel scan over blocks.

A state machine whose events compose is scanned in two sweeps. Going up, each block of
consecutive events of a key is summed up in one summary, and each block of summaries in
one more, until a key has a single one. Going down, each summary block hands the state at
its start to the blocks below, by applying their summaries one after the other; the
lowest blocks then replay their own events. A task holds one block at a time, whatever
share of all events its key has, and there are as many rounds as the events of the
longest key have digits to the base of the block size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut

BLOCK = 4096


class Machine:
    """What a scan needs to know: summaries and states are values that JSON can hold."""

    start: object
    """The state before the first event."""
    emits: str
    """Schema of what emit returns."""

    def summary(self, events: dict[str, list]) -> object:
        raise NotImplementedError

    def combine(self, parts: list) -> object:
        raise NotImplementedError

    def apply(self, summary: object, state: object) -> object:
        raise NotImplementedError

    def emit(self, events: dict[str, list], state: object) -> list[list]:
        """A list for each column of `emits`, as long as the events."""
        raise NotImplementedError


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one _key and _block after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block = batch.column("_key"), batch.column("_block")
        differ = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        turn = (np.flatnonzero(differ) + 1).tolist()
        for a, b in zip([0, *turn], [*turn, batch.num_rows]):
            if held and (held[-1].column("_key")[0], held[-1].column("_block")[0]) != (key[a], block[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _per_block(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            yield work(table)
    return rows.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_place").mapInArrow(run, schema)


def _up(machine: Machine, block: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        made = machine.combine([json.loads(x) for x in table.column("_body").to_pylist()])
        return _summary(table, made, block)
    return work


def _summary(table: pa.Table, made: object, block: int) -> pa.RecordBatch:
    at = table.column("_block")[0].as_py()
    return pa.RecordBatch.from_pydict({"_key": table.column("_key")[:1].combine_chunks(), "_block": pa.array([at // block]),
                                       "_place": pa.array([at]), "_body": pa.array([json.dumps(made)])})


UP = "_key string, _block long, _place long, _body string"


def scan(events: DataFrame, key: str, place: str, columns: list[str], machine: Machine, keep: list[str],
         block: int = BLOCK) -> DataFrame:
    """(key, columns of keep, what the machine emits) for every event. place: 0, 1, 2 … per
    key in order; columns: what the machine reads. NULL keys are a key."""
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = events.select(text.alias("_key"), F.floor(F.col(place) / block).alias("_block"), F.col(place).cast("long").alias("_place"),
                         F.col(key), *dict.fromkeys([*keep, *columns]))

    def lowest(table: pa.Table) -> pa.RecordBatch:
        return _summary(table, machine.summary({c: table.column(c).to_pylist() for c in columns}), block)

    last = rows.agg(F.max("_place")).first()[0]
    levels = [cut(_per_block(rows.select("_key", "_block", "_place", *columns), lowest, UP))]
    width = block
    while last is not None and last // width >= block:  # a key with more than `block` blocks
        levels.append(cut(_per_block(levels[-1], _up(machine, block), UP)))
        width *= block

    def down(table: pa.Table) -> pa.RecordBatch:
        state, keys, places, states = None, [], [], []
        for at, body in zip(table.column("_place").to_pylist(), table.column("_body").to_pylist()):
            if at < 0:
                state = json.loads(body)
                continue
            keys.append(table.column("_key")[0].as_py())
            places.append(at)
            states.append(json.dumps(state))
            state = machine.apply(json.loads(body), state)
        return pa.RecordBatch.from_pydict({"_key": pa.array(keys, pa.string()), "_block": pa.array(places, pa.int64()),
                                           "_body": pa.array(states, pa.string())})

    entry = levels[-1].where("_place = 0").select("_key", F.lit(0).cast("long").alias("_block"), F.lit(json.dumps(machine.start)).alias("_body"))
    for level in levels[::-1]:
        both = level.unionByName(entry.withColumn("_place", F.lit(-1).cast("long")))
        entry = cut(_per_block(both, down, "_key string, _block long, _body string"))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = list(dict.fromkeys([key, *keep]))
    out = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [machine.emits])

    def replay(table: pa.Table) -> pa.RecordBatch:
        state = json.loads(table.column("_body")[0].as_py())
        rest = table.slice(1).combine_chunks()
        made = machine.emit({c: rest.column(c).to_pylist() for c in columns}, state)
        columns_ = [rest.column(c).combine_chunks() if rest.num_rows else pa.array([], rest.schema.field(c).type) for c in names]
        return pa.RecordBatch.from_arrays([*columns_, *[pa.array(c, pa.int64()) for c in made]],
                                          names=[*names, *[f.split()[0] for f in machine.emits.split(", ")]])
    both = rows.unionByName(entry.withColumn("_place", F.lit(-1).cast("long")), allowMissingColumns=True)
    return _per_block(both, replay, out)
