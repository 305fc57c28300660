"""Vector retrieval: exact and cluster-pruned nearest neighbours by cosine distance.

Comparing every query with every chunk is the definition of exact search; what must not happen is
writing those pairs out. Distances are computed as matrix products of bounded blocks inside tasks and
each block emits at most `k` rows per query.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that one task holds of each side, and distances it computes at a time (8 bytes each).
QUERY_BLOCK = 2_000
CHUNK_BLOCK = 50_000
STEP = 2_000_000
# Smaller blocks are cut as asked until so many copies of each row are written; beyond, they grow up to the bounds above.
COPIES = 16
# Most cells that are shipped to tasks: with 1,024 dimensions, 64 MB.
MOST_CELLS = 8_192

_FOUND = "query_id string, chunk_id string, distance double"


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)


def _best(ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest distances, ties by id; undefined distances never match."""
    near = np.flatnonzero(~np.isnan(distance))
    if len(near) > k:
        cut = np.partition(distance[near], k - 1)[k - 1]
        near = near[distance[near] <= cut]
    return near[np.lexsort((ids[near], distance[near]))][:k]


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a (rows, width) array."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return (lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            .astype(np.float64))


def _distances(queries: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Cosine distances to six digits, so that equal vectors tie whatever the batch shape."""
    return np.round(1.0 - _unit(queries) @ _unit(chunks).T, 6) + 0.0


def _table(query_ids: list[str], ids: np.ndarray, distance: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query_ids, pa.string()),
                     "chunk_id": pa.array(ids, pa.string()),
                     "distance": pa.array(distance, pa.float64())})


def _rank(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.asc("distance"), F.asc("chunk_id"))
    return found.withColumn("vector_rank", F.row_number().over(best)).filter(
        F.col("vector_rank") <= k)


def _match_blocks(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best k per query within each (cell, slot, turn); both sides hold bounded blocks.

    Chunks may carry a `strength` and queries an `at_least` that a match has to reach.
    """
    measured = "strength" in chunks.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], np.empty(0, dtype=object), np.empty(0))
        names = right["query_id"].to_pylist()
        asked = _matrix(right["vector"])
        step = max(k, STEP // len(names))
        kept = [(np.empty(0, dtype=object), np.empty(0))] * len(names)
        for at in range(0, left.num_rows, step):
            part = left.slice(at, step)
            ids = part["chunk_id"].to_numpy()
            distances = _distances(asked, _matrix(part["embedding"]))
            if measured:
                distances[part["strength"].to_numpy() < right["at_least"].to_numpy()[:, None]] = np.nan
            for q, row in enumerate(distances):
                pick = _best(ids, row, k)
                all_ids = np.concatenate([kept[q][0], ids[pick]])
                all_distances = np.concatenate([kept[q][1], row[pick]])
                again = _best(all_ids, all_distances, k)
                kept[q] = all_ids[again], all_distances[again]
        return pa.concat_tables([_table([name] * len(ids), ids, far) for name, (ids, far) in zip(names, kept)])

    extra = (["strength"], ["at_least"]) if measured else ([], [])
    block = ["cell", "slot", "turn"]
    left = chunks.select(*block, "chunk_id", "embedding", *extra[0])
    right = queries.select(*block, "query_id", "vector", *extra[1])
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(run, _FOUND)


def _embedded(chunks: DataFrame) -> DataFrame:
    """Chunks that have a vector; a chunk without one is not yet embedded, not infinitely far."""
    return chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")


def nearest(chunks: DataFrame, queries: DataFrame, k: int, block: int = CHUNK_BLOCK,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact k nearest chunks per query: (query_id, chunk_id, distance, vector_rank).

    Filter `chunks` before the call to restrict the search; filtering its result would lose hits.
    All chunks form one cell, cut into blocks on both sides like any other.
    """
    whole = F.lit("all").alias("cell")
    return _rank(_in_cells(_embedded(chunks).select("*", whole),
                           queries.select("query_id", "vector", whole), k, block, query_block), k)


def train_centroids(chunks: DataFrame, cells: int, seed: int = 7) -> DataFrame:
    """k-means centres as (query_id, vector), for use as `centroids` below."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _embedded(chunks).select(array_to_vector(
        F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    centres = KMeans(k=cells, seed=seed).fit(rows).clusterCenters()
    return chunks.sparkSession.createDataFrame(
        [(f"c{i}", [float(x) for x in c]) for i, c in enumerate(centres)],
        "query_id string, vector array<double>")


def nearest_pruned(chunks: DataFrame, queries: DataFrame, centroids: DataFrame, k: int,
                   probes: int, block: int = CHUNK_BLOCK) -> DataFrame:
    """Approximate k nearest: only chunks whose nearest centroid is among the query's `probes`.

    More probes raise recall and cost. A cell holding many chunks is cut into slots of about
    `block` rows, so one dense region of the space does not become one task.
    """
    chunks = _embedded(chunks)
    asked = queries.select("query_id", "vector")
    cell_of = nearest(
        centroids.select(F.col("query_id").alias("chunk_id"), F.col("vector").alias("embedding")),
        asked, probes).select("query_id", F.col("chunk_id").alias("cell"))
    placed = assign_cells(chunks, centroids)
    return _rank(_in_cells(placed, asked.join(cell_of, "query_id"), k, block), k)


def nearest_within(chunks: DataFrame, queries: DataFrame, k: int,
                   block: int = CHUNK_BLOCK) -> DataFrame:
    """Exact k nearest inside the query's own cell, among chunks of `strength >= at_least`.

    For selective filters: `chunks(cell, chunk_id, embedding, strength)`,
    `queries(cell, query_id, vector, at_least)`.
    """
    return _rank(_in_cells(chunks.filter(F.col("embedding").isNotNull()), queries, k, block), k)


def _in_cells(chunks: DataFrame, queries: DataFrame, k: int, block: int,
              query_block: int = QUERY_BLOCK) -> DataFrame:
    """Cut each cell into slots of about `block` chunks and turns of about `query_block` queries,
    and match them block by block, so neither a dense nor a popular cell becomes one task."""
    def parts(rows: int, most: int) -> Column:
        # every chunk goes to all turns and every query to all slots, so tiny blocks would write all pairs
        return F.least(F.ceil(F.count("*") / rows), F.greatest(F.lit(COPIES), F.ceil(F.count("*") / most))).cast("long")

    # one row per cell; cells are centroids or filter values, not data
    asked = queries.groupBy("cell").agg(parts(query_block, QUERY_BLOCK).alias("turns"))
    sizes = chunks.groupBy("cell").agg(parts(block, CHUNK_BLOCK).alias("slots")).join(asked, "cell")
    every = {c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{c}s") - 1)) for c in ("slot", "turn")}
    spread = (chunks.join(sizes, "cell").withColumn("slot", F.pmod(F.xxhash64("chunk_id"), F.col("slots")))
              .withColumn("turn", every["turn"]))
    probing = (queries.join(sizes, "cell").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")))
               .withColumn("slot", every["slot"]))
    return _match_blocks(spread, probing, k)


def assign_cells(chunks: DataFrame, centroids: DataFrame) -> DataFrame:
    """Chunks with the id of their nearest centroid, of which there are MOST_CELLS at most."""
    rows = (centroids.select("query_id", "vector").orderBy("query_id").limit(MOST_CELLS + 1)
            .collect())  # one row per cell; sorted, so ties go to the smaller id
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    ids = np.array([r["query_id"] for r in rows], dtype=object)
    centres = np.array([r["vector"] for r in rows], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest_cell = np.argmin(_distances(centres, _matrix(batch.column(1))), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(ids[nearest_cell], pa.string())],
                    names=["chunk_id", "embedding", "cell"])

    return chunks.mapInArrow(run, "chunk_id string, embedding array<float>, cell string")


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Share of the exact top k that an approximate search returned."""
    hits = truth.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    total = truth.agg(F.count("*").alias("expected"))
    return hits.agg(F.count("*").alias("found")).crossJoin(F.broadcast(total)).select(
        F.lit(k).alias("k"), "expected", "found",
        F.round(F.try_divide("found", "expected"), 4).alias("recall"))


def recall_curve(search: Callable[[DataFrame, int], DataFrame], truth: DataFrame, queries: DataFrame, settings: Sequence[int],
                 k: int, timed: int = 20) -> DataFrame:
    """What each setting of a search (probes, length of a shortlist) finds, and how long one query takes:
    (setting, k, expected, found, recall, p50_ms, p95_ms).

    Recall is that of all queries together. Times are of `timed` queries asked one after another, as users
    ask; the first of each setting warms up and is not counted. A tool for choosing a setting, not for every run.
    """
    asked = [r[0] for r in queries.select("query_id").orderBy("query_id").limit(timed + 1).collect()]
    rows = []
    for setting in settings:
        row = recall(truth, search(queries, setting), k).first()
        times = []
        for name in asked:
            one = queries.filter(F.col("query_id") == name)
            started = time.perf_counter()
            search(one, setting).collect()  # k rows
            times.append(1000 * (time.perf_counter() - started))
        p50, p95 = np.percentile(times[1:] or times or [0.0], [50, 95])
        rows.append((setting, k, row["expected"], row["found"], row["recall"], float(p50), float(p95)))
    return truth.sparkSession.createDataFrame(
        rows, "setting int, k int, expected long, found long, recall double, p50_ms double, p95_ms double")
