"""Refresh of one source of the content corpus: upsert, effect replacement, orphan sweep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.vectors import Embedder
from pulse.operators import corpus


@dataclass(frozen=True)
class CorpusState:
    records: DataFrame
    chunks: DataFrame
    effects: DataFrame


@dataclass(frozen=True)
class Refresh:
    """Everything one refresh decides, as lazy DataFrames."""

    records: DataFrame
    chunks: DataFrame
    stale: DataFrame
    orphan_records: DataFrame
    orphan_chunks: DataFrame
    raw_records: DataFrame
    effects: DataFrame


def decide(state: CorpusState, raw_records: DataFrame, raw_effects: DataFrame, source: str,
           embedder: Embedder) -> Refresh:
    """`raw_records` carry a `position`; duplicates of an id collapse to the last one."""
    records = corpus.last_wins(raw_records, "position").withColumn("source", F.lit(source))
    effects = raw_effects.join(records.select("record_id"), "record_id", "left_semi")
    chunks = corpus.build_chunks(records, effects)
    stale = corpus.stale_chunks(chunks, state.chunks, embedder.model, embedder.dims)
    upserted = (state.records.join(records.select("record_id"), "record_id", "left_anti")
                .unionByName(records.select(*state.records.columns)))
    gone_records = corpus.orphans(upserted, records, "record_id", source)
    # deleting a record takes its chunks along; what is counted here is chunks of kept records
    owned = state.chunks.join(
        upserted.join(gone_records.select("record_id"), "record_id", "left_anti")
        .filter(F.col("source") == source).select("record_id"), "record_id", "left_semi")
    gone_chunks = owned.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return Refresh(records, chunks, stale, gone_records, gone_chunks, raw_records, effects)


def apply(state: CorpusState, r: Refresh, embedder: Embedder) -> CorpusState:
    """The corpus after the refresh; write it as a new version, never over the one being read."""
    gone = r.orphan_records.select("record_id")
    touched = r.records.select("record_id")
    fresh = corpus.embed_chunks(r.stale, embedder)
    records = (state.records.join(touched, "record_id", "left_anti")
               .unionByName(r.records.select(*state.records.columns))
               .join(gone, "record_id", "left_anti"))
    chunks = (state.chunks.join(fresh.select("chunk_id"), "chunk_id", "left_anti")
              .unionByName(fresh.select(*state.chunks.columns))
              .join(gone, "record_id", "left_anti")
              .join(r.orphan_chunks.select("chunk_id"), "chunk_id", "left_anti"))
    effects = (state.effects.join(touched, "record_id", "left_anti")
               .unionByName(r.effects.select(*state.effects.columns))
               .join(gone, "record_id", "left_anti"))
    return CorpusState(records, chunks, effects)


def report(r: Refresh) -> DataFrame:
    """One row of ten counters. Each side is one aggregate; nothing is collected."""
    raw = r.raw_records.agg(F.count("*").alias("raw"))
    kept = r.records.agg(F.count("*").alias("records_upserted"))
    total = r.chunks.agg(F.count("*").alias("chunks_total"))
    stale = r.stale.agg(F.count("*").alias("chunks_written"),
                        F.count_distinct("text_hash").alias("texts_embedded"))
    effects = r.effects.agg(F.count("*").alias("effects_written"))
    gone_records = r.orphan_records.agg(F.count("*").alias("orphan_records_deleted"))
    gone_chunks = r.orphan_chunks.agg(F.count("*").alias("orphan_chunks_deleted"))
    row = raw
    for part in (kept, total, stale, effects, gone_records, gone_chunks):
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row.select(
        (F.col("raw") - F.col("records_upserted")).alias("duplicate_records_collapsed"),
        "records_upserted", "chunks_total",
        (F.col("chunks_total") - F.col("chunks_written")).alias("chunks_skipped"),
        "chunks_written", "texts_embedded",
        (F.col("chunks_written") - F.col("texts_embedded")).alias("duplicates_collapsed"),
        "effects_written", "orphan_records_deleted", "orphan_chunks_deleted")
