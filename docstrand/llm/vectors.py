"""Vectors between Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each dimension, of the vectors that are not null, not zero and hold no null or
    non-finite component."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        if not d:
            continue
        rows = np.flatnonzero(sizes == d)
        x = flat[at[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither tiny nor huge components are lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def is_single(vectors) -> bool:
    """Whether the components of the embedding column of a DataFrame are stored in single precision."""
    return vectors.schema["embedding"].dataType.elementType.typeName() == "float"


def packed(x: np.ndarray, single: bool) -> pa.Array:
    """Rows of a matrix as binary; in single precision where the components came in it, which loses nothing."""
    x = np.ascontiguousarray(x, np.float32 if single else np.float64)
    return pa.array([v.tobytes() for v in x], pa.binary())


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Packed rows of one dimension as a float64 matrix."""
    rows = column.to_pylist()
    data = b"".join(rows)
    kind = np.float32 if len(data) == 4 * dim * len(rows) else np.float64
    return np.frombuffer(data, kind).reshape(len(rows), dim).astype(np.float64)
