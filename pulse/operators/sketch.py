"""Approximate nearest neighbours from compact codes: scan codes, keep a shortlist, compare vectors.

Vectors are turned by a learned rotation, cut into pairs of dimensions, and each pair is replaced by the
nearest of 256 learned points: one byte for two dimensions, a sixteenth of the doubles that exact search
multiplies. The codes of all chunks are scanned in blocks; a query keeps its `SHORTLIST` best by estimated
cosine, and only their vectors are fetched and compared exactly. Codes are four bits a dimension, so the
estimate's error stays far below the spread of a shortlist ten times the answer, whatever the number of
chunks and whether or not they cluster.

Rotation and points are fitted on the driver on the SAMPLE vectors with the smallest id hashes; every
vector is coded. The codebook's size depends on the width alone (64 dimensions: 80 KB).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.operators.vector import _best, _matrix, _rank, _table, _unit
from pulse.session import stored

SAMPLE = 10_000  # vectors the codebook is fitted on, at most
POINTS = 256
PAIR = 2  # dimensions of one code
SHORTLIST = 100  # chunks compared exactly for one query
CODE_BLOCK = 500_000
QUERY_BLOCK = 1_000
STEP = 4_000_000  # estimates made at a time (4 bytes each)


@dataclass(frozen=True)
class Codebook:
    """`turn`: (width, pairs * PAIR), columns in the order of their pairs; `points`: (pairs, POINTS, PAIR)."""

    turn: np.ndarray
    points: np.ndarray

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return (_unit(vectors) @ self.turn).astype(np.float32)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, pairs) bytes."""
        x = self.turned(vectors)
        codes = np.empty((len(x), len(self.points)), np.uint8)
        for j, points in enumerate(self.points):
            part = x[:, j * PAIR:(j + 1) * PAIR]
            codes[:, j] = np.argmin((points ** 2).sum(1) - 2 * part @ points.T, axis=1)
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.points[np.arange(len(self.points)), codes].reshape(len(codes), -1)


def _lloyd(x: np.ndarray, rounds: int, rnd: np.random.Generator) -> np.ndarray:
    """POINTS centres of the rows of `x`; unused ones are put on random rows."""
    centres = x[rnd.choice(len(x), POINTS, replace=len(x) < POINTS)].copy()
    for _ in range(rounds):
        nearest = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
        size = np.bincount(nearest, minlength=POINTS)
        sums = np.stack([np.bincount(nearest, x[:, d], POINTS) for d in range(x.shape[1])], 1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rnd.integers(0, len(x), POINTS)])
    return centres


def fit(vectors: np.ndarray, rounds: int = 12, seed: int = 7) -> Codebook:
    """Principal axes, the widest paired with the narrowest so that pairs carry alike; then the points."""
    rnd = np.random.default_rng(seed)
    unit = _unit(np.asarray(vectors, np.float64))
    width = unit.shape[1]
    _, axes = np.linalg.eigh(np.cov(unit.T).reshape(width, width) if len(unit) > 1 else np.eye(width))
    pairs = -(-width // PAIR)
    padded = np.zeros((width, pairs * PAIR))
    padded[:, :width] = axes
    order = np.stack([np.arange(pairs), np.arange(pairs * PAIR)[::-1][:pairs]], 1).ravel()
    turn = padded[:, order]
    x = unit @ turn
    points = np.stack([_lloyd(x[:, j * PAIR:(j + 1) * PAIR], rounds, rnd) for j in range(pairs)])
    return Codebook(turn, points.astype(np.float32))


def _measurable(chunks: DataFrame) -> DataFrame:
    """Chunks with a direction: a vector that is there and not zero."""
    some = F.exists("embedding", lambda x: x != 0)
    return chunks.filter(F.col("embedding").isNotNull() & some).select("chunk_id", "embedding")


def train(chunks: DataFrame, sample: int = SAMPLE) -> Codebook | None:
    """The codebook of a table of (chunk_id, embedding); None when it holds no vector."""
    rows = _measurable(chunks).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).toArrow()
    return fit(_matrix(rows["embedding"])) if rows.num_rows else None


def encode(chunks: DataFrame, book: Codebook) -> DataFrame:
    """(chunk_id, code) of every chunk that has a vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = book.encode(_matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array([c.tobytes() for c in codes], pa.binary())],
                                                 names=["chunk_id", "code"])
    return _measurable(chunks).mapInArrow(run, "chunk_id string, code binary")


def shortlist(codes: DataFrame, queries: DataFrame, book: Codebook, most: int = SHORTLIST,
              block: int = CODE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, chunk_id) of the `most` chunks of each query with the largest estimated cosine."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], np.empty(0, dtype=object), np.empty(0))
        asked = book.turned(_matrix(right["vector"]))
        names = right["query_id"].to_pylist()
        kept = [(np.empty(0, dtype=object), np.empty(0))] * len(names)
        step = max(most, STEP // len(names))
        for at in range(0, left.num_rows, step):
            part = left.slice(at, step)
            ids = part["chunk_id"].to_numpy()
            raw = part["code"].combine_chunks()
            held = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(ids), -1)
            estimate = -np.round(asked @ book.decode(held).T, 5).astype(np.float64)  # a distance: smaller is nearer
            for q, row in enumerate(estimate):
                pick = _best(ids, row, most)
                names_, far = np.concatenate([kept[q][0], ids[pick]]), np.concatenate([kept[q][1], row[pick]])
                again = _best(names_, far, most)
                kept[q] = names_[again], far[again]
        return pa.concat_tables([_table([name] * len(ids), ids, far) for name, (ids, far) in zip(names, kept)])

    def parts(frame: DataFrame, size: int) -> int:
        return max(1, -(-frame.count() // size))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    slots, turns = parts(codes, block), parts(queries, query_block)
    asked = queries.filter(F.col("vector").isNotNull()).select(
        "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(turns)).alias("turn"),
        every(slots).alias("slot"))
    spread = codes.select("chunk_id", "code", F.pmod(F.xxhash64("chunk_id"), F.lit(slots)).alias("slot"),
                          every(turns).alias("turn"))
    found = (spread.groupBy("slot", "turn").cogroup(asked.groupBy("slot", "turn"))
             .applyInArrow(run, "query_id string, chunk_id string, distance double"))
    return _rank(found, most).select("query_id", "chunk_id")


def nearest(chunks: DataFrame, queries: DataFrame, k: int, most: int = SHORTLIST, book: Codebook | None = None,
            codes: DataFrame | None = None) -> DataFrame:
    """Approximate k nearest chunks per query: (query_id, chunk_id, distance, vector_rank), distances exact.

    `book` and `codes` are what `train` and a stored `encode` gave; without them they are made here.
    """
    book = book or train(chunks)
    if book is None:
        return _rank(chunks.sparkSession.createDataFrame([], "query_id string, chunk_id string, distance double"), k)
    codes = stored(encode(chunks, book), "vector-codes") if codes is None else codes
    pairs = stored(shortlist(codes, queries, book, max(most, k)), "vector-shortlist")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = _unit(_matrix(batch.column("vector"))), _unit(_matrix(batch.column("embedding")))
                far = np.round(1.0 - np.einsum("ij,ij->i", left, right), 6) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("chunk_id"), pa.array(far)],
                                                 names=["query_id", "chunk_id", "distance"])
    met = (pairs.join(chunks.select("chunk_id", "embedding"), "chunk_id")
           .join(queries.select("query_id", "vector"), "query_id").select("query_id", "chunk_id", "vector", "embedding"))
    return _rank(met.mapInArrow(compare, "query_id string, chunk_id string, distance double").filter(~F.isnan("distance")), k)
