"""Removal of passages that repeat: Rabin-Karp hashes of every fixed-length window of words.

Every window of ``size`` words gets a rolling hash. Each task first keeps only the earliest occurrence
of a hash in each slice of its input, so a passage held by a third of all rows reaches the exchange once
per slice. What is left is dealt out by the window's smallest inner hash of ``INNER`` words (equal
windows share it, and neighbours mostly do, so a run of windows needs one position). A task counts the
windows of one range after the other and reports the positions of all occurrences but the earliest. The
positions of a document (never more than its words) meet its text again, merge into maximal intervals
and are cut.

The number of ranges follows the number of input partitions, so a range stays small at any input size.
56 bits of the hash are compared within a range: two different windows of one range are taken for equal
with probability 2^-56.

Defined results: an earlier window is one in a smaller doc_id or earlier in the same document; null
ids come first; rows that share an id are told apart by a hash of their text, rows that share both are
one document and get the same result; a null text has no words; texts shorter than a window lose
nothing; an empty table gives an empty result; other columns are only carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm import texts

SIZE = 20
SLICE = 12 << 20
RANGES_PER_PARTITION = 16
INNER = 8
FLUSH = 1 << 20

# One dealt row: the documents of a slice with windows in a range (first id and differences), the runs
# of each, where each run starts, its length, and 7 bytes of every hash (none for known repeats).
_FIELDS = ("ids", "contents", "runs", "starts", "lengths", "hashes")
DEALT = "part int, first long, " + ", ".join(f"{n} binary" for n in _FIELDS)
_DEALT_ARROW = pa.schema([("part", pa.int32()), ("first", pa.int64()), *((n, pa.binary()) for n in _FIELDS)])
FOUND = "__id long, __content long, at binary"
_FOUND_ARROW = pa.schema([("__id", pa.int64()), ("__content", pa.int64()), ("at", pa.binary())])
NO_ID = -(1 << 63)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _row(part: int, ids, contents, owner, hashes, at) -> tuple:
    """One dealt row; windows ascend by document and position."""
    begins = np.concatenate([[0], np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)) + 1])
    lengths = np.diff(begins, append=len(at))
    docs, runs = np.unique(owner[begins], return_counts=True)
    steps = np.diff(ids[docs], prepend=ids[docs[:1]])
    small = np.uint32 if len(steps) == 0 or 0 <= steps.min() and steps.max() < 1 << 32 else np.int64
    return (part, int(ids[docs[0]]), steps.astype(small).tobytes(), contents[docs].tobytes(), runs.astype(np.uint32).tobytes(),
            at[begins].astype(np.uint32).tobytes(), lengths.astype(np.uint32).tobytes(),
            np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes())


def _unpack(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, contents, positions, hashes) of the windows of dealt rows."""
    ids, contents, at = [], [], []
    for _, first, steps, content, runs, starts, lengths, _ in rows:
        content = np.frombuffer(content, np.int64)
        steps = np.frombuffer(steps, np.uint32 if len(steps) == 4 * len(content) else np.int64).astype(np.int64)
        runs, lengths = np.frombuffer(runs, np.uint32), np.frombuffer(lengths, np.uint32).astype(np.int64)
        per_doc = np.add.reduceat(lengths, (np.cumsum(runs) - runs).astype(np.int64))
        ids.append(np.repeat(first + np.cumsum(steps), per_doc))
        contents.append(np.repeat(content, per_doc))
        at.append(texts.ranges(np.frombuffer(starts, np.uint32).astype(np.int64), lengths))
    raw = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(-1, 7)
    hashes = np.zeros((len(raw), 8), np.uint8)
    hashes[:, :7] = raw
    return np.concatenate(ids), np.concatenate(contents), np.concatenate(at), hashes.view("<u8").ravel()


def smallest_inner(hashes: np.ndarray, size: int, inner: int) -> np.ndarray:
    """For each window of ``size`` words the smallest hash of its sub-windows of ``inner`` words."""
    low, width, span = texts.window_hashes(hashes, inner), 1, size - inner + 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def _deal(size: int, ranges: int):
    shift = np.uint64(64 - max(1, (ranges - 1).bit_length()))
    kind = np.uint16 if ranges <= 1 << 16 else np.uint32

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        ids = _ids(part.column("__id"))
        contents = part.column("__content").to_numpy()
        order = np.lexsort((contents, ids))
        part = part.take(pa.array(order))
        ids, contents = ids[order], contents[order]
        data, offsets = texts.text_bytes(part.column("text"))
        starts, ends, word_offsets = texts.words(data, offsets)
        inside = np.flatnonzero(texts.whole_windows(word_offsets, size))
        if not len(inside):
            return
        by_word = texts.word_hashes(data, starts, ends)
        hashes = texts.window_hashes(by_word, size)[inside]
        target = (texts.mix(smallest_inner(by_word, size, min(INNER, size))[inside]) >> shift).astype(kind)
        owner = np.searchsorted(word_offsets, inside, "right") - 1
        at = inside - word_offsets[owner]
        by_hash = np.argsort(hashes, kind="stable")
        again = np.zeros(len(hashes), bool)
        again[by_hash[1:]] = hashes[by_hash[1:]] == hashes[by_hash[:-1]]
        if len(ids) > 1:  # a row repeated as a whole is one document
            copy = np.zeros(len(ids), bool)
            copy[1:] = (ids[1:] == ids[:-1]) & (contents[1:] == contents[:-1])
            again_or_copy = again | copy[owner]
            again &= ~copy[owner]
        else:
            again_or_copy = again
        if again.any():
            yield _row(int(target[0]), ids, contents, owner[again], np.zeros(0, np.uint64), at[again])
        first = ~again_or_copy
        hashes, owner, at, target = hashes[first], owner[first], at[first], target[first]
        order = np.argsort(target, kind="stable")
        hashes, owner, at, target = hashes[order], owner[order], at[order], target[order]
        cuts = np.flatnonzero(np.diff(target)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(target)]):
            if high > low:
                yield _row(int(target[low]), ids, contents, owner[low:high], hashes[low:high], at[low:high])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "text", SLICE):
                held, weight = [], 0
                for row in rows(part):
                    held.append(row)
                    weight += len(row[5]) + len(row[7])
                    if weight > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _DEALT_ARROW.types)], schema=_DEALT_ARROW)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _DEALT_ARROW.types)], schema=_DEALT_ARROW)
    return run


def later_ones(hashes: np.ndarray, ids: np.ndarray, contents: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indexes of all entries but the earliest of each hash.

    Entries equal in all four come from copies of one row in several slices: they are one window.
    """
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order[1:]] == hashes[order[:-1]]
    several = np.zeros(len(order), bool)
    several[1:] |= equal
    several[:-1] |= equal
    few = order[several]
    few = few[np.lexsort((at[few], contents[few], ids[few], hashes[few]))]
    equal = [x[few[1:]] == x[few[:-1]] for x in (hashes, ids, contents, at)]
    few = few[np.concatenate([[True], ~np.logical_and.reduce(equal)])] if len(few) else few
    return few[1:][hashes[few[1:]] == hashes[few[:-1]]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions to cut, per document; rows arrive ordered by range."""
    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> pa.RecordBatch:
        ids, contents, at = (np.concatenate(c) for c in zip(*pending))
        order = np.lexsort((at, contents, ids))
        ids, contents, at = ids[order], contents[order], at[order].astype(np.uint32)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (contents[1:] != contents[:-1])) + 1
        lows = np.concatenate([[0], cuts])
        edges = np.append(lows, len(ids)).astype(np.int32) * 4
        at_column = pa.Array.from_buffers(pa.binary(), len(lows), [None, pa.py_buffer(edges), pa.py_buffer(at)])
        return pa.RecordBatch.from_arrays([pa.array(ids[lows]), pa.array(contents[lows]), at_column], schema=_FOUND_ARROW)

    def settle(rows: list[tuple]) -> int:
        ids, contents, at, hashes = _unpack(rows)
        n = len(at) - len(hashes)  # rows without hashes come first: known repeats
        if n:
            pending.append((ids[:n], contents[:n], at[:n]))
        gone = later_ones(hashes, ids[n:], contents[n:], at[n:]) + n
        pending.append((ids[gone], contents[gone], at[gone]))
        return n + len(gone)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                waiting += settle(sorted(held, key=lambda r: len(r[7]) > 0))
                held = []
                if waiting > FLUSH:
                    yield flush()
                    pending.clear()
                    waiting = 0
            held.append(row)
    if held:
        waiting += settle(sorted(held, key=lambda r: len(r[7]) > 0))
    if waiting:
        yield flush()


def repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """__id, __content, at: window starts (uint32) to cut, in one or more pieces for each document."""
    ranges = 1 << (RANGES_PER_PARTITION * texts.partitions(docs) - 1).bit_length()
    dealt = docs.mapInArrow(_deal(size, ranges), DEALT)
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_count, FOUND)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("__id"), F.xxhash64(docs["text"]).alias("__content"), docs["text"])


def covered(n_words: int, at: np.ndarray, size: int) -> np.ndarray:
    """Mask of the words in any window that starts in ``at``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def intervals(gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal [from, to) runs of a mask."""
    steps = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()))


def with_cuts(docs: DataFrame, at: str, size: int = SIZE) -> DataFrame:
    """All columns of ``docs`` and ``at``: an array of binary pieces, null when nothing repeats."""
    own, own_content, other, other_content = (texts.fresh(n, docs) for n in ("own", "own_content", "other", "other_content"))
    found = (repeats(keyed(docs), size).groupBy(F.col("__id").alias(other), F.col("__content").alias(other_content))
             .agg(F.collect_list("at").alias(at)))
    rows = docs.withColumns({own: F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), own_content: F.xxhash64(docs["text"])})
    return rows.join(found, (F.col(own) == F.col(other)) & (F.col(own_content) == F.col(other_content)), "left")


def _cut_rows(part: pa.RecordBatch, at: str, size: int) -> Iterator[tuple[int, int, bytes | None, list]]:
    """(words, removed, kept words joined by a space, intervals) of each row."""
    for text, pieces in zip(part.column("text").to_pylist(), part.column(at).to_pylist()):
        words = (text or "").encode().split()
        if not pieces:
            yield len(words), 0, b" ".join(words), []
            continue
        gone = covered(len(words), np.frombuffer(b"".join(pieces), np.uint32).astype(np.int64), size)
        yield len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g), intervals(gone)


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, cuts (maximal intervals of removed words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "text"):
                rows = [(n, gone, hashlib.sha256(kept).hexdigest(), [list(c) for c in cuts]) for n, gone, kept, cuts in _cut_rows(part, "at", size)]
                n, gone, sha, cuts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                     pa.array(cuts, pa.list_(pa.list_(pa.int32())))],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "cuts"])
    rows = with_cuts(docs.select("doc_id", "text"), "at", size).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "at")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, cuts array<array<int>>")


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (others keep their text as it is) and, where
    there is such a column, ``n_chars`` counted anew."""
    names, at = docs.columns, texts.fresh("at", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "text"):
                old = part.column("text").to_pylist()
                new = [t if not gone else kept.decode() for t, (_, gone, kept, _) in zip(old, _cut_rows(part, at, size))]
                columns = [part.column(c) for c in names]
                columns[names.index("text")] = pa.array(new, part.schema.field("text").type)
                yield pa.RecordBatch.from_arrays(columns, names=names)
    cut = with_cuts(docs, at, size).select(*(F.col(f"`{c}`") for c in names), at).mapInArrow(run, docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cut
