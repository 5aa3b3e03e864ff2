"""Helpers for Arrow code that runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows recut so that rows with equal integer keys never part.

    Holds one incoming batch and the group at its border.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and not _same(held[-1], batch, keys):
            yield _joined(held)
            held = []
        changes = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
        at = np.flatnonzero(changes)
        if len(at):
            cut = int(at[-1])
            held.append(batch.slice(0, cut))
            yield _joined(held)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _same(left: pa.RecordBatch, right: pa.RecordBatch, keys: list[str]) -> bool:
    return all(left.column(k)[-1].as_py() == right.column(k)[0].as_py() for k in keys)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def bounds(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    if len(values) == 0:
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]


def int_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column and each list's bounds; null reads as empty."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return flat, np.r_[0, np.cumsum(sizes)]


def binary(column: pa.Array, row: int) -> memoryview:
    """One value of a binary column without a copy."""
    return memoryview(column[row].as_buffer())
