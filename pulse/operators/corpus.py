"""Content corpus: chunks, change detection, refresh, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions import text as T
from pulse.functions.vectors import Embedder

CHUNKED_TYPES = ("BOOK",)
HASH_SALTS = 64


def last_wins(records: DataFrame, position: str, key: str = "record_id") -> DataFrame:
    """One row per id, the last by position. Aggregated, so copies collapse before the shuffle."""
    rest = [c for c in records.columns if c != key]
    return (records.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_row"))
            .select(key, "_row.*").drop(position))


def effect_phrases(effects: DataFrame) -> DataFrame:
    """Distinct "effect target" phrases per record in first-seen order.

    Repeats are dropped before collecting: the collected list is bounded by the effect vocabulary.
    """
    phrase = F.concat_ws(" ", "effect_name", "affected")
    firsts = effects.groupBy("record_id", phrase.alias("phrase")).agg(
        F.min("ordinal").alias("at"))
    return firsts.groupBy("record_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "phrase"))),
                    lambda x: x["phrase"]).alias("phrases"))


def search_text(records: DataFrame, effects: DataFrame) -> DataFrame:
    """Text to embed: what an item does, not only its name. Magnitudes stay relational."""
    said = F.concat(F.col("full_text"), F.lit(". "), F.array_join("phrases", ". "), F.lit("."))
    return (records.join(effect_phrases(effects), "record_id", "left")
            .withColumn("search_text", F.coalesce(said, F.col("full_text"))).drop("phrases"))


def build_chunks(records: DataFrame, effects: DataFrame) -> DataFrame:
    """`record_id#ordinal` chunks. Only long-form types are cut; the rest is one chunk."""
    pieces = F.when(F.col("type").isin(*CHUNKED_TYPES), T.chunk(F.col("full_text"))).otherwise(
        F.array("search_text"))
    return (search_text(records, effects)
            .select("record_id", F.posexplode(pieces).alias("ordinal", "text"))
            .filter(F.col("text") != "")
            .select(F.concat("record_id", F.lit("#"), F.col("ordinal").cast("string"))
                    .alias("chunk_id"), "record_id", "ordinal", "text",
                    F.sha2("text", 256).alias("text_hash")))


def stale_chunks(wanted: DataFrame, stored: DataFrame, model: str, dims: int) -> DataFrame:
    """Chunks whose (text, model, dims) differ from what is stored, or that are not stored."""
    known = stored.select("chunk_id", F.col("text_hash").alias("_hash"),
                          F.col("embedding_model").alias("_model"),
                          F.col("embedding_dims").alias("_dims"))
    same = (F.col("text_hash").eqNullSafe(F.col("_hash")) & F.col("_model").eqNullSafe(model)
            & F.col("_dims").eqNullSafe(dims))
    return wanted.join(known, "chunk_id", "left").filter(~same).select(*wanted.columns)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Embed each distinct text once and hand the vector to every chunk that has the text.

    A text shared by a large part of all chunks would make one join key huge; chunks are spread
    over `HASH_SALTS` slots and a vector is repeated only for the slots its text occurs in.
    """
    salted = chunks.withColumn("_slot", F.pmod(F.xxhash64("chunk_id"), F.lit(HASH_SALTS)))
    texts = salted.groupBy("text_hash").agg(F.min("text").alias("text"),
                                            F.collect_set("_slot").alias("_slots"))
    vectors = (texts.withColumn("embedding", embedder.column(F.col("text")))
               .select("text_hash", "embedding", F.explode("_slots").alias("_slot")))
    return (salted.join(vectors, ["text_hash", "_slot"]).drop("_slot")
            .withColumns({"embedding_model": F.lit(embedder.model),
                          "embedding_dims": F.lit(embedder.dims)}))


def orphans(stored: DataFrame, live: DataFrame, key: str, source: str) -> DataFrame:
    """Stored rows of this source that the new load no longer contains; other sources are safe."""
    return stored.filter(F.col("source") == source).join(live.select(key), key, "left_anti")


def provenance_violations(chunks: DataFrame) -> DataFrame:
    """Embedding, model and dims are all there or all absent, and the width is as declared."""
    parts = [F.col(c).isNull().cast("int")
             for c in ("embedding", "embedding_model", "embedding_dims")]
    mixed = ~(parts[0] + parts[1] + parts[2]).isin(0, 3)
    width = F.col("embedding").isNotNull() & (F.size("embedding") != F.col("embedding_dims"))
    return chunks.withColumn("violation", F.when(mixed, "partial provenance")
                             .when(width, "wrong width")).filter("violation IS NOT NULL")


def merge_sources(loads: list[tuple[str, DataFrame]]) -> DataFrame:
    """Records of several sources in load order; a later source overrides an earlier one."""
    numbered = [rows.withColumns({"source": F.lit(name), "_load": F.lit(i)})
                for i, (name, rows) in enumerate(loads)]
    merged = numbered[0]
    for rows in numbered[1:]:
        merged = merged.unionByName(rows)
    return last_wins(merged, "_load")


def effect_counts(records: DataFrame, effects: DataFrame) -> DataFrame:
    """Effects per record under its case-folded id."""
    counts = effects.groupBy("record_id").agg(F.count("*").alias("n"))
    return (records.join(counts, "record_id", "left")
            .groupBy(F.lower("record_id").alias("id"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("effects")))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Classify every id by how the stored effects compare with the source's."""
    want, got = F.col("want"), F.col("got")
    verdict: Column = (F.when(got.isNull(), "missing").when(want.isNull(), "extra")
                       .when(got < want, "fewer").when(got > want, "more").otherwise("same"))
    return (expected.select("id", F.col("effects").alias("want"))
            .join(actual.select("id", F.col("effects").alias("got")), "id", "full")
            .groupBy(verdict.alias("verdict"))
            .agg(F.count("*").alias("records"), F.coalesce(F.sum("want"), F.lit(0))
                 .alias("expected_effects"),
                 F.coalesce(F.sum("got"), F.lit(0)).alias("actual_effects")))
