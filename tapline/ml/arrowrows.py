"""Numpy rows in and out of Arrow columns without pandas, which every Python worker would hold in memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def floats(column: pa.Array) -> np.ndarray:
    """The values of a double column without nulls (``to_numpy`` would load pandas)."""
    return np.frombuffer(column.buffers()[1], float, len(column), column.offset * 8) if len(column) else np.zeros(0)


def vectors(x: pa.Array, width: int) -> np.ndarray:
    """Rows × features of a list column."""
    return floats(x.flatten()).reshape(len(x), width)


def cell(type_: pa.DataType, content: bytes) -> pa.Array:
    """One value from its bytes (``pa.array`` would load pandas)."""
    if not pa.types.is_binary(type_):
        return pa.Array.from_buffers(type_, 1, [None, pa.py_buffer(content)])
    return pa.Array.from_buffers(type_, 1, [None, pa.py_buffer(np.array([0, len(content)], np.int32)), pa.py_buffer(content)])


def lists(rows: np.ndarray) -> pa.Array:
    """An Arrow list column of equally long rows."""
    n, width = rows.shape
    starts = np.arange(n + 1, dtype=np.int32) * width
    values = pa.Array.from_buffers(pa.float64(), n * width, [None, pa.py_buffer(np.ascontiguousarray(rows, float))])
    return pa.Array.from_buffers(pa.list_(pa.float64()), n, [None, pa.py_buffer(starts)], children=[values])
