"""Columnar helpers shared by the operators: Arrow text as flat byte arrays,
word boundaries, and position-independent 64-bit hashes of byte ranges."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa

#: Sub-batches handed to numpy hold about this many text bytes (or one longer text).
SLICE_BYTES = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
_R = 0x9E3779B97F4A7C13  # = 3 mod 8
_R_INV = pow(_R, -1, 1 << 64)


def flat(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (len + 1, from 0) of a string or binary column; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if offs is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


@functools.lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def frugal(run):
    """run, a task's function over batches, that gives its memory back when it ends: Spark keeps its
    workers from one stage to the next, and idle ones keep what they have freed but not returned."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _powers.cache_clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(_libc(), "malloc_trim"):
                _libc().malloc_trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES):
    """Zero-copy runs of rows whose `col` holds about `limit` bytes."""
    _, offs = flat(batch.column(col))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def spans(data: np.ndarray, offs: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and word offsets per text; no word crosses
    texts. cuts: where besides a word starts if the byte is not white."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ink = ~WHITE[data]
    before, after = np.append(False, ink[:-1]), np.append(ink[1:], False)
    heads, tails = offs[:-1], offs[1:]
    before[heads[heads < len(data)]] = False
    after[tails[tails > 0] - 1] = False
    if cuts is not None:
        before &= ~cuts
        after[:-1] &= ~cuts[1:]
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


@functools.lru_cache(maxsize=4)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _R, U64), np.full(n, _R_INV, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int):
    return _powers(1 << max(16, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Hasher:
    """Hashes of byte ranges of one array; equal ranges have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_table(seed)[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of all positions of the ranges, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    to = np.cumsum(lens) - lens
    return np.repeat(starts - to, lens) + np.arange(total, dtype=np.int64)


def as_strings(data: np.ndarray, offs: np.ndarray, binary: bool = False) -> pa.Array:
    """A column over existing bytes, without a copy."""
    kind = pa.large_binary() if binary else pa.large_string()
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary() if binary else pa.string())


def code_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of code points of each UTF-8 text."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return heads[offs[1:]] - heads[offs[:-1]]
