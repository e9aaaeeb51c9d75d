"""Vectorised text kernels over Arrow string columns.

A chunk of documents is handled as one flat UTF-8 byte array with offsets; words, hashes and counts come from array
operations, never from a Python loop over words.  Chunks are bounded by bytes (``CHUNK``), so memory in a worker stays
bounded whatever the batch size is; one text longer than that is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 19
#: Word separators of every operator here: the bytes 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_ODD2 = _U(0xC2B2AE3D27D4EB4F)
#: Spans of more bytes are hashed by the library, one by one.
LONG = 64
#: Keeps the first k bytes of a little-endian number of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def release() -> None:
    """Gives memory that a task has freed back to the system; workers live on and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], which doesn't depend on where the span lies.

    Eight bytes at a time go through a bijective mixer, so spans of one length up to eight never share a hash, and longer
    ones only by chance; spans above ``LONG`` bytes are hashed with XXH3."""
    size = end - start
    h = mix(size.astype(_U) * _ODD)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    long = np.flatnonzero(size > LONG)
    live, first = np.flatnonzero((size > 0) & (size <= LONG)), start
    if len(live) == len(size):  # the usual case, without picking
        h = mix(h ^ eights[start] & _FIRST[np.minimum(size, 8)])
        live, first = np.flatnonzero(size > 8), start + 8
        left = size - 8
    else:
        left = size
    while len(live):
        n = left[live]
        h[live] = mix(h[live] ^ eights[first[live]] & _FIRST[np.minimum(n, 8)])
        left, first = left - 8, first + 8
        live = live[n > 8]
    view = memoryview(np.ascontiguousarray(data))
    for k in long.tolist():
        h[k] = xxhash.xxh3_64_intdigest(view[start[k] : end[k]])
    return h


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def owners(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, at, "right") - 1


def per_row(counted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over each row's bytes."""
    total = np.zeros(len(counted) + 1, np.int64)
    np.cumsum(counted, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, a maximal run of bytes that aren't separators."""
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, owners(offsets, start)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    return span_hashes(LOWER[data] if lower else data, start, end)


def rows_of(row: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's entries in arrays that are ordered by row."""
    return np.searchsorted(row, np.arange(n + 1))


def sequence_hashes(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit hash of each row's words, lower-cased and with one space between them.

    ``row`` and ``end`` are those of the rows' words."""
    inside = ~SPACE[data]
    inside[end[:-1][row[1:] == row[:-1]]] = True
    place = np.concatenate([[0], np.cumsum(inside)])
    flat = LOWER[data[inside]]
    flat[SPACE[flat]] = 0x20
    view, bounds = memoryview(flat), place[offsets].tolist()
    halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(bounds, bounds[1:])]), "<u8").reshape(-1, 2)
    return halves[:, 0].astype(_U), halves[:, 1].astype(_U)


def windows(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` hashes from each place on."""
    h = np.full(len(at), width, _U) * _ODD
    for k in range(width):
        h = (h ^ (h >> _U(29))) * _ODD2 ^ hashes[at + k]
    return mix(h)


def shingles(hashes: np.ndarray, row: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every window of ``width`` words; a row of fewer words (but some) has one of all of them."""
    bounds = rows_of(row, n)
    count = np.diff(bounds)
    m = max(0, len(hashes) - width + 1)
    whole = np.flatnonzero(row[:m] == row[width - 1 : width - 1 + m])
    out_row, out = row[whole], windows(hashes, whole, width)
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            out_row, out = np.concatenate([out_row, short]), np.concatenate([out, windows(hashes, bounds[short], k)])
    return out_row, out


def sorted_rows(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` in order within each row, rows in order."""
    if len(row) and (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, values = row[order], values[order]
    values = values.copy()
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    for a, b in zip(at.tolist(), np.append(at[1:], len(row)).tolist()):
        values[a:b].sort()
    return row, values


def distinct(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), ordered by row and then value."""
    row, values = sorted_rows(row, values)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return row[new], values[new]
