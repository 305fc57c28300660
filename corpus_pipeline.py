"""A corpus-cleaning pipeline of the text operators (counted as part of ``pulse.llm``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulse.llm import exact, jaccard, packing, quality, substrings


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.deduplicate(docs, smallest=False)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with five-word shingles alike by 80 per cent the smallest doc_id stays."""
    return jaccard.keep_one(docs, words=5, share=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that an earlier document (or part) holds are cut."""
    return substrings.remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left goes into sequences of at most 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("jaccard_join", jaccard_stage),
          ("substring_dedup", substring_stage),
          ("best_fit_packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before wrote."""
    from pulse.session import stored
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
