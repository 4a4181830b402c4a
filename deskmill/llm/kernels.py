"""Vectorised text kernels: whole Arrow columns as one byte array, no Python loop per word or byte.

A text column becomes ``data`` (uint8) and ``offs`` (n + 1 offsets). Words, n-grams, lines and fixed windows get
64-bit hashes from one prefix sum of ``code[byte] * BASE**position`` modulo 2**64, so any span costs O(1).
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 60_000  # a row's number in its chunk fits 16 bits

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII letters, digits and non-ASCII bytes.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.random.default_rng(77).integers(1, 2**63, 64, dtype=U) * U(2) + U(1)
_POW: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) <= n:
        size = max(2 * len(_POW[0]), n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POW[k] = np.multiply.accumulate(steps)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    c = np.zeros(len(data) + 1, U)
    np.cumsum(_CODE[data] * _powers(len(data))[0][: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inv = _powers(len(c))[1]
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def window_hash(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte window, by start."""
    n = len(c) - k
    return mix((c[k:] - c[:n]) * _powers(len(c))[1][:n]) if n > 0 else np.empty(0, U)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)), offs


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    return (np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)), offs


def chunks(data: np.ndarray, offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``size`` bytes: (first row, last row + 1, bytes, offsets from 0). A row is never cut."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), lo + CHUNK_ROWS, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def documents(batches: Iterable[pa.RecordBatch], size: int = CHUNK_BYTES, lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of (id, text) batches, in chunks."""
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            text = batch.column(1)
            data, offs = utf8(pc.utf8_lower(text) if lower else text)
            for lo, hi, d, o in chunks(data, offs, size):
                yield ids[lo:hi], d, o
    release()


def release() -> None:
    """Give free memory back: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def words(data: np.ndarray, offs: np.ndarray, stop: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run without ``stop`` bytes; runs end with their row."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    inside = ~stop[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_or(~inside[:-1], edge[1:-1], out=before[1:])
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_or(~inside[1:], edge[1:-1], out=after[:-1])
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def sequence_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i], ..., h[i + n - 1] by i, for every i that has all n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U)
    acc = np.full(m, U(n))
    for k in range(n):
        acc += h[k : k + m] * _ODD[k]
    return mix(acc)


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-grams of each row as (row, 48-bit hash), sorted; a row of 1 to n - 1 words has one, of all of them."""
    data = LOWER[data]
    s, e, row = words(data, offs)
    h = span_hash(prefix(data), s, e)
    keys = []
    whole = sequence_hash(h, n)
    same = row[: len(whole)] == row[n - 1 :][: len(whole)]
    keys.append((row[: len(whole)][same].astype(U) << U(48)) | (whole[same] >> U(16)))
    count = np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            keys.append((short.astype(U) << U(48)) | (sequence_hash(h, m)[first[short]] >> U(16)))
    key = np.unique(np.concatenate(keys))
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1)


def sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over x[i : i + w] for each i with a whole window, in three passes at any w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = np.full((-(-len(x) // w), w), fill, x.dtype)
    blocks.reshape(-1)[: len(x)] = x
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after another."""
    total = int(length.sum())
    at = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(start, length) + at
