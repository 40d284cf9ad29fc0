"""Vectors of an Arrow list column as matrices of integers, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 1 << 21
LOW, HIGH = -2.0 ** 63, 2.0 ** 63 - 1024         # the doubles at the ends of a long


def finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable, offsets, entries): entries as doubles, and which vectors are neither null nor hold a null, NaN or infinity."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~np.isfinite(entries)))
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    return usable, offsets, entries


def floors(entries: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * entry) as longs; what a long cannot hold becomes its nearest end."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * scale), LOW, HIGH).astype(np.int64)


def matrices(column: pa.Array, dims: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer rows of the usable vectors with ``dims`` components, a bounded number of cells at a time."""
    usable, offsets, entries = finite(column)
    rows = np.flatnonzero(usable & (np.diff(offsets) == dims))
    step = max(1, CELLS // max(1, dims))
    for first in range(0, len(rows), step):
        part = rows[first:first + step]
        yield part, floors(entries[offsets[part][:, None] + np.arange(dims)], scale)


def lists(values: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = values.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32),
                                    pa.array(values.ravel()))


def of_list(column: pa.Array) -> np.ndarray:
    """The matrix of a list column whose lists have one length and no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def exact(values: np.ndarray, largest: float) -> np.ndarray:
    """``values`` as they are if results up to ``largest`` fit a long, else as Python integers."""
    return values if largest < 2.0 ** 62 else values.astype(object)


def longs(values: np.ndarray) -> pa.Array:
    """Integers of any size as longs; null where a long cannot hold one."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if -2 ** 63 <= v < 2 ** 63 else None for v in values], pa.int64())
