"""Fixed-width vectors between Arrow list columns and numpy, without per-row objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column) -> np.ndarray:
    """A list column of equal-length vectors as an (n, width) double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(column) and values.size % len(column):
        raise ValueError("vectors of one column differ in length")
    return values.reshape(len(column), -1)


def vectors(rows: np.ndarray) -> pa.Array:
    """An (n, width) matrix as a list column."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel(), pa.float64()))


def blocks(cells, size: int, axis: str) -> tuple[np.ndarray, np.ndarray]:
    """A list<struct<r, c, v>> column as (n, size, size) dense tiles, and which places of ``axis`` ("r" or "c") hold a cell."""
    lengths = np.diff(cells.offsets.to_numpy(zero_copy_only=False))
    flat = cells.flatten()
    field = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
    out = np.zeros((len(cells), size, size))
    of = np.repeat(np.arange(len(cells)), lengths)
    out[of, field("r"), field("c")] = field("v")
    held = np.zeros((len(cells), size), bool)
    held[of, field(axis)] = True
    return out, held
