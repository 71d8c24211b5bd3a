"""Vectorised text kernels: whole Arrow batches as flat byte arrays, no Python loop over words or bytes.

All hashes are 64-bit and content-only, so they are the same in every task and on every run.
Arithmetic on uint64 wraps, which numpy does silently for arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MULT = U(0x9E3779B97F4A7C15)
WORD_MULT = U(0xD6E8FEB86659FD93)
TOP = U(0xFFFFFFFFFFFFFFFF)
CHUNK_BYTES = 500_000


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective finaliser (splitmix64), so equal inputs and only equal inputs collide."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_codes() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 11)


BYTE_CODES = _byte_codes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    bufs = col.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _is_space() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def _is_alnum() -> np.ndarray:
    """Of the class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] on UTF-8 bytes: digits, a-z and every byte of a non-ASCII character."""
    t = np.ones(256, bool)
    t[0x00:0x30] = False
    t[0x3A:0x61] = False
    t[0x7B:0x80] = False
    return t


BLANK_WORD = ~_is_space()
ALNUM_WORD = _is_alnum()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of WORD_MULT and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(19, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inv = pow(int(WORD_MULT), -1, 1 << 64)
        up, down = np.full(size, WORD_MULT), np.full(size, U(inv))
        up[0] = down[0] = U(1)
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and n+1 word offsets by row. Words never cross rows.

    kind: for each byte whether it belongs to a word. lower: A-Z are hashed as a-z.
    """
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = np.zeros(n + 1, bool)
    inside[:n] = kind[data]
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), np.zeros(len(off), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    up, down = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    h = mix(h ^ (ends - starts).astype(np.uint64) * MULT)
    return starts, ends, h, np.searchsorted(starts, off).astype(np.int64)


def word_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the first k bytes (A-Z as a-z) of every word that is longer than k bytes; for a shorter one 0."""
    long = ends - starts > k
    at = starts[long]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = h * MULT + BYTE_CODES[LOWER[data[at + j]]]
    out = np.zeros(len(starts), np.uint64)
    out[long] = mix(h, seed)
    return out


def grams(h: np.ndarray, k: int, mult: U = MULT) -> np.ndarray:
    """Hash of every k consecutive items: sum of h[i+j] * mult**(k-1-j), by doubling; length len(h)-k+1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, power = None, 0, h
    width, m = 1, int(mult)
    step = m
    while True:
        if k & width:
            if out is None:
                out, done = power, width
            else:  # out covers [0, done), power the next width items
                left = out[: len(h) - done - width + 1]
                out = left * U(step) + power[done : done + len(left)]
                done += width
        if done == k:
            return out
        nxt = len(power) - width
        power = power[:nxt] * U(step) + power[width : width + nxt]
        width, step = width * 2, step * step & 0xFFFFFFFFFFFFFFFF


def sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) of every w consecutive items, length len(x)-w+1."""
    if len(x) < w:
        return x[:0]
    width = 1
    while width * 2 <= w:
        x = op(x[:-width], x[width:])
        width *= 2
    rest = w - width
    return op(x[:-rest], x[rest:]) if rest else x


def row_of(off: np.ndarray) -> np.ndarray:
    """Row of each item, from offsets by row."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions inside any [start, end), all of it within 0 and n."""
    if len(starts) and (starts.min() < 0 or ends.max() > n):
        raise ValueError(f"a span leaves its {n} units")
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def give_back() -> None:
    """Free memory that this process holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim is not None:
        trim(0)


def tidy(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """scan, with memory given back to the system at its end: Python workers stay idle beside later stages of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        give_back()

    return run


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
