"""Array helpers that the text operators share inside Spark tasks.

A *word* is a run of bytes other than 0x20 and 0x09-0x0D. Everything here works on the bytes of an
Arrow column at once and in windows of bounded size, so one very long text needs no more scratch
memory than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20  # bytes (or words) worked on at a time
SLICE = 4 << 20  # bytes of text in one slice of a batch

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Lower-case letters, digits and all bytes beyond ASCII stand for themselves, A-Z for a-z, the rest for blanks.
TERMS = np.full(256, 0x20, np.uint8)
TERMS[0x30:0x3A] = np.arange(0x30, 0x3A)
TERMS[0x61:0x7B] = TERMS[0x41:0x5B] = np.arange(0x61, 0x7B)
TERMS[0x80:] = np.arange(0x80, 0x100)

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LETTER_LOWER = LETTER[LOWER]
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    """base^0 .. base^(size-1) modulo 2^64."""
    out = np.full(size, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, size: int) -> np.ndarray:
    return _powers(base, max(WINDOW + 64, 1 << int(size).bit_length()))[:size]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows that hold about ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty. Offsets start at 0."""
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = pc.fill_null(column, empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, first = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[first:first + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and where each text's words begin (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = LETTER) -> np.ndarray:
    """A 64-bit polynomial hash of each byte range (ranges ascend and do not overlap)."""
    out = np.empty(len(starts), np.uint64)
    first, n = 0, len(starts)
    back = inverse(BASE)
    while first < n:
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + WINDOW, "right")))
        high = int(ends[last - 1])
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(letters[data[low:high]] * powers(BASE, high - low), dtype=np.uint64, out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        value = (sums[e] - sums[s]) * powers(back, high - low + 1)[s]
        out[first:last] = mix(value + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp values of all windows of ``size`` consecutive entries."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    base, back = 0xD1342543DE82EF95, inverse(0xD1342543DE82EF95)
    for low in range(0, n, WINDOW):
        high = min(n, low + WINDOW)
        part = hashes[low:high + size - 1]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * powers(base, len(part)), dtype=np.uint64, out=sums[1:])
        out[low:high] = mix((sums[size:] - sums[:-size]) * powers(back, len(part))[:high - low])
    return out


def whole_windows(word_offsets: np.ndarray, size: int) -> np.ndarray:
    """Mask over window starts: those whose window lies within one text."""
    total = int(word_offsets[-1])
    n = max(0, total - size + 1)
    keep = np.ones(n, bool)
    for edge in word_offsets[1:-1]:
        keep[max(0, edge - size + 1):min(n, edge)] = False
    return keep


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + length - 1 for each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def fresh(name: str, frame) -> str:
    """``name``, made longer until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(frame) -> int:
    """Input partitions of a DataFrame; grows with the input and sizes what is dealt out by hash.

    Meant for tables read from storage: asking a frame with exchanges may run them.
    """
    return max(1, frame.rdd.getNumPartitions())
