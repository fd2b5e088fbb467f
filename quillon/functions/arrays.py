"""Arrow list columns as matrices, and groups of rows within a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column as a matrix of doubles; rows of another length or with nulls are an error."""
    a = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if not len(a):
        return np.empty((0, 1))
    flat = a.flatten()
    if a.null_count or flat.null_count or len(a.value_lengths().unique()) > 1:
        raise ValueError("vectors of a group differ in length or lack values")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as list<double>."""
    x = np.ascontiguousarray(x, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.ravel()))


def groups(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The values of ``keys`` and the places of their rows."""
    names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
    places: dict[tuple, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(i)
    for name, at in places.items():
        yield name, np.array(at)
