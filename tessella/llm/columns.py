"""Moving text columns between Spark and numpy, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
"""Texts are handled in runs of about this many bytes, so that the working arrays
of a task stay small; one longer text is a run of its own."""


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text starts (NULL: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.zeros(0, np.uint8)
    return held, at - at[0]


def runs(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text."""
    n = batch.num_rows
    if n == 0:
        return
    column = batch.column(batch.schema.get_field_index(text))
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < n:
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is linked to, over others too."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, i, low[j])
        np.minimum.at(now, j, low[i])
        now = now[now]
        if (now == low).all():
            return low
        low = now
