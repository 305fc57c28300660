"""Ranked lexical search of many items over all documents, by pipelined term partitioning.

Terms belong to owners. A bundle is an item's terms with their weights and a sparse accumulator of
scores by document; it goes from owner to owner, each a cogroup of bundles with the owner's postings that
adds the contributions of its own terms, all in integers. The last owner selects instead of passing on.

Owners go from rare terms to frequent ones (by the share of documents that hold a term), so accumulators
stay sparse until the last stage, where the most frequent terms are added and only the best remain.
Postings and bundles meet by block of documents (a hash of the row, about BLOCK documents) and turn of
items (about TURN items): a term held by a third of all documents is spread over all blocks, and a task
holds one block and one turn whatever the size of the tables.

What leaves the scan of the texts are a document's length and its counts of terms that some item may
hold, told by a table of fixed size (SLOTS bits) over their hashes. Terms are known by 64-bit hashes.

Defined results: a null or empty text has no terms and is never ranked; each row of the documents is a
document of its own, also with a null or repeated id (null ids come last among equal scores); rows that
share an item id are one item; an item without terms, or whose terms no document holds, gives no rows;
empty tables give an empty result; columns beyond id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm import texts
from pulse.session import stored

SLOT_BITS = 18
# An owner has the terms held by at most one in so many documents (and by more than the owner before);
# one more owner has the rest.
OWNERS = (64, 16, 4)
BLOCK = 4096  # documents of one block, on average
TURN = 256  # items of one turn, on average

_BUNDLE = "block long, turn long, item_id long, plan array<struct<owner:int,term:long,w:long>>, docs array<int>, scores array<long>"
_COUNTS = "id long, n long, terms array<long>, tfs array<int>"


def _slots(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def count_terms(rows: DataFrame, name: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(id, n, terms, tfs) of every text: terms with repeats, and how often it has each term whose slot is wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "text"):
                data, offsets = texts.text_bytes(part.column("text"))
                folded = texts.TERMS[data]
                starts, ends, bounds = texts.words(folded, offsets)
                hashes = texts.word_hashes(folded, starts, ends)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(part.num_rows), n)
                if wanted is not None:
                    live = wanted[_slots(hashes)]
                    hashes, owner = hashes[live], owner[live]
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(new)
                tfs = np.diff(heads, append=len(hashes))
                cuts = pa.array(np.searchsorted(owner[heads], np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(hashes[heads].view(np.int64))),
                     pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int32()))], names=["id", "n", "terms", "tfs"])
    return rows.select(rows[name].cast("long").alias("id"), rows["text"].cast("string").alias("text")).mapInArrow(run, _COUNTS)


def _by_slot(frame: DataFrame, empty: int, dtype: type) -> np.ndarray:
    """A column `value` by slot as an array; at most one row per slot comes to the driver."""
    rows = frame.select("slot", "value").toPandas()
    out = np.full(1 << SLOT_BITS, empty, dtype)
    out[rows["slot"].to_numpy()] = rows["value"].to_numpy()
    return out


def _owned(corpus: DataFrame, owners: np.ndarray, stage: int) -> DataFrame:
    """All documents with the postings of one owner's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, tfs = batch.column("terms"), batch.column("tfs")
            flat = terms.flatten().to_numpy(zero_copy_only=False)
            mine = owners[_slots(flat.view(np.uint64))] == stage
            lengths = np.bincount(pc.list_parent_indices(terms).to_numpy()[mine], minlength=batch.num_rows)
            cuts = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("n"), pa.ListArray.from_arrays(cuts, pa.array(flat[mine])),
                 pa.ListArray.from_arrays(cuts, tfs.flatten().filter(pa.array(mine)))], names=["row", "id", "n", "terms", "tfs"])
    return corpus.select("row", "id", "n", "terms", "tfs").mapInArrow(run, "row long, id long, n long, terms array<long>, tfs array<int>")


class _Postings:
    """One owner's postings in one block: documents in the order of their ids, contributions by term."""

    def __init__(self, block: pa.Table, n_docs: int, n_terms: int):
        order = pc.sort_indices(block, sort_keys=[("id", "ascending"), ("row", "ascending")])  # null ids last
        block = block.take(order).combine_chunks()
        self.ids, self.size = block["id"].combine_chunks(), block.num_rows
        terms = block["terms"].combine_chunks()
        owner = pc.list_parent_indices(terms).to_numpy()
        tf = block["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 50 + 50 * block["n"].to_numpy() * n_docs // n_terms
        flat = terms.flatten().to_numpy()
        by_term = np.argsort(flat, kind="stable")
        self.terms, self.docs, tf = flat[by_term], owner[by_term], tf[by_term]
        self.parts = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs])

    def add(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        lows, highs = np.searchsorted(self.terms, terms, "left"), np.searchsorted(self.terms, terms, "right")
        for a, b, w in zip(lows.tolist(), highs.tolist(), weights.tolist()):
            scores[self.docs[a:b]] += w * self.parts[a:b]  # a document stands once under a term


def _bundles(right: pa.Table) -> Iterator[tuple[int, int | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row number, item, its plan (owners, terms, weights) and accumulator (documents, scores)."""
    plan = right["plan"].combine_chunks()
    steps = plan.flatten()
    owner, term, w = (steps.field(i).to_numpy() for i in range(3))
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(plan).to_numpy())])
    docs, scores = right["docs"].combine_chunks(), right["scores"].combine_chunks()
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(docs).to_numpy())])
    docs, scores = docs.flatten().to_numpy(), scores.flatten().to_numpy()
    for i, item in enumerate(right["item_id"].to_pylist()):
        p, a = slice(cuts[i], cuts[i + 1]), slice(at[i], at[i + 1])
        yield i, item, owner[p], term[p], w[p], docs[a], scores[a]


def _stage(stage: int, last: bool, n_docs: int, n_terms: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            postings = _Postings(left, n_docs, n_terms)
            for _, item, owner, term, w, docs, before in _bundles(right):
                scores = np.zeros(postings.size, np.int64)
                scores[docs] = before
                mine = owner == stage
                postings.add(scores, term[mine], w[mine])
                live = np.flatnonzero(scores > 0)
                if last:
                    if len(live) > k:
                        # the k best, and all that tie with the last of them; then by the order of ids
                        floor = np.partition(scores[live], len(live) - k)[len(live) - k]
                        live = live[scores[live] >= floor]
                        live = live[np.lexsort((live, -scores[live]))][:k]
                    found[0] += [item] * len(live)
                    found[1].append(live)
                    found[2].append(scores[live])
                else:
                    found[0].append(len(live))
                    found[1].append(live)
                    found[2].append(scores[live])
        docs, scores = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found[1:])
        if last:
            ids = postings.ids.take(pa.array(docs)) if len(docs) else pa.array([], pa.int64())
            return pa.table({"item_id": pa.array(found[0], pa.int64()), "doc_id": ids, "score": pa.array(scores)})
        if not found[0]:
            return pa.table({name: pa.array([], kind) for name, kind in _ARROW.items()})
        cuts = pa.array(np.concatenate([[0], np.cumsum(found[0])]), pa.int32())
        return pa.table({"block": right["block"], "turn": right["turn"], "item_id": right["item_id"], "plan": right["plan"],
                         "docs": pa.ListArray.from_arrays(cuts, pa.array(docs, pa.int32())),
                         "scores": pa.ListArray.from_arrays(cuts, pa.array(scores))})
    return run


_ARROW = {"block": pa.int64(), "turn": pa.int64(), "item_id": pa.int64(),
          "plan": pa.list_(pa.struct([("owner", pa.int32()), ("term", pa.int64()), ("w", pa.int64())])),
          "docs": pa.list_(pa.int32()), "scores": pa.list_(pa.int64())}


def search(docs: DataFrame, items: DataFrame, k: int = 50, block: int = BLOCK, turn: int = TURN,
           owners: tuple[int, ...] = OWNERS) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score; equal scores by doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    asked = stored(count_terms(items, "item_id").select(F.col("id").alias("item_id"), F.explode("terms").alias("term")).distinct()
                   .withColumn("slot", F.shiftrightunsigned("term", 64 - SLOT_BITS)), "ranked-items")
    wanted = _by_slot(asked.select("slot").distinct().withColumn("value", F.lit(True)), False, bool)
    corpus = stored(count_terms(docs, "doc_id", wanted).filter("n > 0").withColumn("row", F.monotonically_increasing_id()), "ranked-counts")
    n_docs, n_terms = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    held = corpus.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1)
    owner = sum((F.when(F.col("df") * share > n_docs, 1).otherwise(0) for share in owners), F.lit(0))
    weighed = stored(asked.join(held, "term").select("item_id", "term", "slot", owner.alias("owner"),
                                                     F.floor(1000 * F.log(ratio)).cast("long").alias("w")), "ranked-terms")
    # terms of one slot go to one owner, the latest of theirs
    per_slot = weighed.groupBy("slot").agg(F.max("owner").cast("int").alias("value"))
    table = _by_slot(per_slot, 255, np.uint8)

    blocks, n_items = max(1, -(-n_docs // block)), asked.select("item_id").distinct().count()
    turns = max(1, -(-n_items // turn))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    bundles = (weighed.join(per_slot, "slot").groupBy("item_id")
               .agg(F.collect_list(F.struct(F.col("value").alias("owner"), "term", "w")).cast("array<struct<owner:int,term:long,w:long>>").alias("plan"))
               .select(every(blocks).alias("block"), F.pmod(F.xxhash64("item_id"), F.lit(turns)).alias("turn"), "item_id", "plan",
                       F.array().cast("array<int>").alias("docs"), F.array().cast("array<long>").alias("scores")))
    for stage in range(len(owners) + 1):
        last = stage == len(owners)
        postings = _owned(corpus, table, stage).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("turn", every(turns))
        bundles = (postings.groupBy("block", "turn").cogroup(bundles.groupBy("block", "turn"))
                   .applyInArrow(_stage(stage, last, n_docs, n_terms, k), "item_id long, doc_id long, score long" if last else _BUNDLE))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (bundles.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
