"""Words of whole Arrow batches as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D, so words never split
a character. All functions take texts as one byte buffer plus row offsets.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
MULTIPLIER = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: multiply, shift, xor."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def release() -> None:
    """Give freed memory back to the system, as a Python worker stays when its task is over."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most ``limit`` text bytes, or of one row."""
    try:
        yield from _slices(batches, column, limit)
    finally:
        release()


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (one more at the end). ``separator`` says of each byte if it ends words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    filled = offsets[1:] > offsets[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][filled]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[1:][filled] - 1
    last[at] = inside[at]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all bytes of the given spans, in order, and where each span begins among them."""
    size = end - start
    begin = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - begin, size), begin


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each span's bytes among the distinct ones, the distinct ones): spans have equal numbers if and only if they have equal bytes."""
    index, begin = spans(start, end)
    offsets = np.append(begin, len(index)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))])
    told = column.dictionary_encode()
    return told.indices.to_numpy(zero_copy_only=False), told.dictionary


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    index, begin = spans(start, end)
    size = end - start
    place = np.arange(len(index)) - np.repeat(begin, size)
    value = BYTE_VALUE[data[index]] * powers(MULTIPLIER, int(size.max()))[place]
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64))


def hash_runs(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive values (n - k + 1 of them), by prefix sums modulo 2**64."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(MULTIPLIER, n), dtype=np.uint64, out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * powers(INVERSE, n - k + 1))


def normalised(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and each word's start and end in that."""
    index, begin = spans(start, end)
    to = begin + np.arange(len(start))
    out = np.full(len(index) + len(start), 0x20, np.uint8)
    out[np.arange(len(index)) + np.repeat(np.arange(len(start)), end - start)] = data[index]
    return out.tobytes(), to, to + (end - start)


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive values, by doubling."""
    f = np.minimum if least else np.maximum
    n, have, out = len(values) - width + 1, 1, values
    if n <= 0:
        return values[:0]
    while have * 2 <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[:n], out[width - have : width - have + n])
