"""Sorted numbers as a few binary values: what a task sends through a shuffle in bulk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, first all lowest ones: what is alike compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def numbers(column: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    """The numbers of such values, one after the other."""
    out = np.empty(sum(len(x.as_buffer()) for x in column) // 8, kind)
    at = 0
    for x in column:
        part = np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1)
        out[at : at + part.shape[1]].view(np.uint8).reshape(-1, 8)[:] = part.T
        at += part.shape[1]
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal numbers."""
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(x)))
