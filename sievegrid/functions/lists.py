"""Arrow list columns as flat numpy values and back, without Python lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, whole) of a list column; ``whole`` rows are neither null nor hold a null."""
    offsets = column.offsets.to_numpy()
    values = column.values
    whole = column.is_valid().to_numpy(zero_copy_only=False)
    if values.null_count:
        nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        whole = whole & (nulls[offsets[1:]] == nulls[offsets[:-1]])
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), offsets, whole


def blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose ``sizes`` add up to ``limit`` at most; a larger row stands alone."""
    ends = np.cumsum(sizes, dtype=np.float64)
    low = 0
    while low < len(ends):
        done = ends[low - 1] if low else 0.0
        high = max(low + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield low, high
        low = high


def rows_of(values: np.ndarray, offsets: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The rows ``at``, all of ``length`` values, as a matrix."""
    return values[offsets[at][:, None] + np.arange(length)]


def column(parts: list[np.ndarray | None]) -> pa.ListArray:
    """A list column of doubles; None is null."""
    sizes = [0 if p is None else p.size for p in parts]
    bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    whole = [p.reshape(-1) for p in parts if p is not None]
    values = pa.array(np.concatenate(whole).astype(np.float64, copy=False) if whole else np.zeros(0))
    return pa.ListArray.from_arrays(bounds, values, mask=pa.array([p is None for p in parts], pa.bool_()))
