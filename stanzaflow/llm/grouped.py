"""Arrow helpers for tasks whose rows come sorted by a group's columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as a binary column."""
    rows = np.ascontiguousarray(rows)
    rows = rows.view(np.uint8).reshape(len(rows), rows.itemsize * rows.shape[1])
    n, width = rows.shape
    ends = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """From rows that come grouped: tables that end where a group ends, and their groups' starts with the end."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in by:
            x = t.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(batch.column(c)[0] == held[-1].column(c)[-1] for c in by):
            at = starts(batch)
            held.append(batch.slice(0, at[1]))
            batch = batch.slice(at[1])
            if not batch.num_rows:
                continue
        last = starts(batch)[-2]
        held.append(batch.slice(0, last))
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        for t in whole:
            yield t, starts(t)
        held = [batch.slice(last)]
    if held:
        for t in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield t, starts(t)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal widths as a matrix of bytes."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[at : at + len(column) * width].reshape(len(column), width)
