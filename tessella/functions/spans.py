"""Spans in one text as array<struct<start, end, text, type, confidence>>.

start is 0-based, end exclusive, both in characters. A text is one row, so its
spans are a bounded array and every step below is map-only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.rows import bind

SPAN = "array<struct<start:int,end:int,text:string,type:string,confidence:double>>"


def none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def span(start: Column, text: Column, kind: Column, confidence: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"),
                    text.alias("text"), kind.alias("type"), confidence.cast("double").alias("confidence"))


def matches(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, text>> of a regular expression: the matches and the
    gaps between them alternate, so running lengths give the offsets. A text
    without a match is scanned once, any other twice."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    empty = F.expr("cast(array() as array<struct<start:int,text:string>>)")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        return F.struct((start + F.length(pair["hit"])).alias("at"), F.array_append(
            acc["out"], F.struct(start.alias("start"), pair["hit"].alias("text"))).alias("out"))

    def located(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(F.split(text, p, -1), 1, F.size(found)),
                           lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.when(F.size(found) == 0, empty).otherwise(
            F.aggregate(pairs, zero, step, lambda a: a["out"]))
    return bind(F.regexp_extract_all(text, p, 0), located)


def of_pattern(text: Column, pattern: str, kind: str, confidence: float, needs: str | None = None) -> Column:
    """Spans of a regular expression, matched only in texts that hold what it needs. needs: the
    pattern that tells so, if not the same one."""
    found = F.transform(matches(text, pattern), lambda m: span(
        m["start"], m["text"], F.lit(kind), F.lit(confidence)))
    held = tx.holds(text, needs or pattern, 16)
    return found if held is None else F.when(text.isNull() | held, found).otherwise(none())


def occurrences(text: Column, word: Column) -> Column:
    """Start of every occurrence of a word, overlapping ones included."""
    pieces = F.split(text, F.concat(F.lit(r"(?=\Q"), word, F.lit(r"\E)")), -1)
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    starts = F.aggregate(pieces, zero, lambda a, p: F.struct(
        (a["at"] + F.length(p)).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    return F.when(F.startswith(text, word), starts).otherwise(F.slice(starts, 2, F.size(starts) - 1))


def of_names(text: Column, names: Column) -> Column:
    """Spans of a literal array<struct<name, type, confidence>>."""
    present = F.filter(names, lambda n: F.contains(text, n["name"]))
    return F.flatten(F.transform(present, lambda n: F.transform(
        occurrences(text, n["name"]), lambda s: span(s, n["name"], n["type"], n["confidence"]))))


def overlaps(a: Column, b: Column) -> Column:
    return (a["end"] > b["start"]) & (a["start"] < b["end"])


def not_touching(candidates: Column, kept: Column) -> Column:
    return F.filter(candidates, lambda c: ~F.exists(kept, lambda k: overlaps(c, k)))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), 0))


ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("type", pa.string()),
                            ("confidence", pa.float64())]))


def fields(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Of an array of lists of structs: the row of every element, and the fields as arrays."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten().flatten()


def lists(rows: int, of: np.ndarray, columns: list[pa.Array], kind: pa.ListType, mask: pa.Array | None = None) -> pa.Array:
    """The reverse of `fields`: lists of structs; of: the row of every element, ascending."""
    offsets = pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32))
    names = [f.name for f in kind.value_type]
    items = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind.value_type)], names=names)
    return pa.ListArray.from_arrays(offsets, items, mask=mask).cast(kind)
