"""Reuse of encoded text chunks inside a task, for tokenizers.

A text is cut into chunks at places where no token can cross; equal chunks of all texts of a slice are
found at once (an Arrow dictionary), the new ones are encoded together and remembered. The memory is
bounded: when it is full, chunks that were met only once are forgotten.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from pulse.llm import texts

MEMORY = 600_000  # chunks remembered by a task

# Bytes beside which a cut is surely right: ASCII other than white space and controls, and the last
# byte of a two-byte character from 0xC3 on. Two- and three-byte white space and anything longer are
# not in it, so no cut is made beside them.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xCC] = True  # Latin letters; combining marks begin at 0xCC


def safe_gaps(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of single spaces or line ends between two surely plain characters of one text."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < len(data) - 1)]
    left, right = data[at - 1], data[at + 1]
    two = (at > 1) & _LEAD2[data[np.maximum(at - 2, 0)]] & ((left & 0xC0) == 0x80)
    good = (_PLAIN[left] | two) & (_PLAIN[right] | _LEAD2[right])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    return at[good & ~edge[at] & ~edge[at + 1]]


class Encoder:
    """``encode`` maps a list of chunks (bytes) to (the chunks in an order of its own, all their ids one
    after the other, ids per chunk)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[bytes], np.ndarray, np.ndarray]], memory: int = MEMORY):
        self.encode, self.memory = encode, memory
        self.place: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)
        self.used = 0

    def _forget(self) -> None:
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > self.memory // 2:
            keep = keep[:0]
        names = list(self.place)
        pool = self.pool[texts.ranges(self.starts[keep], self.lengths[keep])]
        self.place = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.met = np.ones(len(keep), np.int64)
        self.pool, self.used = pool, len(pool)

    def _add(self, names: list[bytes]) -> None:
        names, ids, lengths = self.encode(names)
        total = len(ids)
        if self.used + total > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + total), np.uint32)
            grown[:self.used] = self.pool[:self.used]
            self.pool = grown
        self.pool[self.used:self.used + total] = ids
        first = len(self.place)
        self.place.update(zip(names, range(first, first + len(names))))
        self.starts = np.append(self.starts, self.used + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.met = np.append(self.met, np.zeros(len(names), np.int64))
        self.used += total

    def __call__(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids begin)."""
        return self.gather(*self.entries(data, offsets, cuts))

    def entries(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in memory of every chunk, where each text's chunks begin)."""
        bounds = np.union1d(offsets, cuts)
        if len(bounds) < 2:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                       [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.place) + len(names) > self.memory:
            self._forget()
        new = [n for n in names if n not in self.place]
        if new:
            self._add(new)
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        self.met[at] += 1
        return at[coded.indices.to_numpy()], np.searchsorted(bounds, offsets)

    def gather(self, at: np.ndarray, chunk_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[at]
        ids = self.pool[texts.ranges(self.starts[at], lengths)]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        return ids, ends[chunk_offsets]
