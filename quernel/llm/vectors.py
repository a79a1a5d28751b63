"""Reading list columns of numbers as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def by_length(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each length of vector.

    Rows that are null, empty or hold null or non-finite components are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return []
    rows = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    starts = np.asarray(column.offsets, dtype=np.int64)[:-1]
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    out = []
    for length in np.unique(lengths[rows]):
        own = rows[lengths[rows] == length]
        if length == 0:
            continue
        matrix = flat[starts[own][:, None] + np.arange(length)]
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            out.append((own[good], matrix[good]))
    return out
