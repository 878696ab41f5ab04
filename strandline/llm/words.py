"""Vectorised word splitting and hashing over Arrow string columns (numpy, bounded chunks of whole texts)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20


def _table(excluded: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for lo, hi in excluded:
        table[lo : hi + 1] = False
    return table


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, both exact on UTF-8 bytes.
BLANK_SEPARATED = _table([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = np.ones(1, U)
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(10, (n - 1).bit_length())
        step = np.full(size, _BASE, U)
        step[0] = 1
        _POWERS = np.cumprod(step, dtype=U)
    return _POWERS


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) over whole texts; a text longer than the limit is a chunk of its own. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step, after which freed memory goes back to the system: Python workers are reused, beside the next stage's JVM."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


class Words:
    """The words of a chunk: start, end (byte offsets), doc (row in the chunk), lens; first[i]..first[i+1] are those of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = BLANK_SEPARATED, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = table[self.data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[offsets[:-1][offsets[:-1] < n]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.lens = self.end - self.start
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.empty(0, U)
        at = np.cumsum(self.lens) - self.lens
        place = np.arange(int(self.lens.sum())) - np.repeat(at, self.lens)
        terms = (self.data[self.inside].astype(U) + U(1)) * powers(int(self.lens.max()))[place]
        return mix(np.add.reduceat(terms, at) + self.lens.astype(U) * _STEP)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive values, by doubling; the caller drops those that cross rows."""
    if len(h) < k:
        return np.empty(0, U)
    out, taken, power, size = None, 0, h, 1
    while taken < k:
        if k & size:
            part = power[taken : taken + len(h) - k + 1]
            out = mix(part + U(size)) if out is None else mix(out * _BASE + part + U(size))
            taken += size
        if taken < k:
            power = mix(power[:-size] * _STEP + power[size:])
            size *= 2
    return out


def fold(h: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """One hash for the sequence h[first[i]:first[i+1]] of each row."""
    counts = np.diff(first)
    out = np.zeros(len(counts), U)
    if len(h):
        place = np.arange(len(h)) - np.repeat(first[:-1], counts)
        terms = mix(h + U(seed)) * powers(int(counts.max()))[place]
        full = counts > 0
        out[full] = np.add.reduceat(terms, first[:-1][full])
    return mix(out + counts.astype(U) * _STEP + U(seed))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
