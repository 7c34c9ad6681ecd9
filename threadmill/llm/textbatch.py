"""Vectorised views of Arrow text batches.

A Spark task hands its Python worker record batches.  The helpers here look at
the UTF-8 bytes of many whole texts at once (numpy, no per-row loop).  A batch
is cut into slices of about ``SLICE_BYTES`` so that the working arrays of one
task stay at a few dozen megabytes whatever the batch holds; a single text
longer than that makes a slice of its own and is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

#: The separators of a word: ``[^\x20\x09-\x0D]+`` is a word.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that start a code point.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def tidy() -> None:
    """Gives the memory of a task's arrays back to the system: its worker lives on, idle
    or in another stage, and would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public SplitMix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, modulo 2**64."""
    if _POWERS["n"] < n:
        for name, b in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a)
        _POWERS["n"] = n
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit rolling hash of each span; equal spans hash equally wherever they stand."""
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Slice:
    """Some whole texts: their bytes laid end to end, and where each begins."""

    data: np.ndarray  # uint8
    offs: np.ndarray  # int64, one more than there are texts
    first: int  # index of the first text in its batch

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    @cached_property
    def nonspace(self) -> np.ndarray:
        return ~IS_SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word and the text it is in."""
        full, size = self.nonspace, len(self.data)
        if not size:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        starts = full.copy()
        starts[1:] &= ~full[:-1]
        heads = self.offs[:-1][self.offs[:-1] < self.offs[1:]]
        starts[heads] = full[heads]
        ends = full.copy()
        ends[:-1] &= ~full[1:]
        tails = heads[1:] - 1
        ends[tails] = full[tails]
        s = np.flatnonzero(starts)
        return s, np.flatnonzero(ends) + 1, self.text_of(s)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, side="right") - 1

    @cached_property
    def pre(self) -> np.ndarray:
        return prefix(_BYTE[self.data])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(self.pre, start, end)

    def per_text(self, values: np.ndarray, text: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=values, minlength=self.n).astype(np.int64)

    def inside(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a string or binary column in order; a null counts as an empty text."""
    first = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        if chunk.null_count:
            chunk = chunk.fill_null(b"" if pa.types.is_binary(chunk.type) or pa.types.is_large_binary(chunk.type) else "")
        _, at, body = chunk.buffers()
        offs = np.frombuffer(at, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            yield Slice(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], first + i)
            i = j
        first += len(chunk)
