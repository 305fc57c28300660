"""Copies that the block-wise vector search writes."""

from pyspark.sql import functions as F

from pulse.operators import vector


def test_small_blocks_write_few_copies(spark, monkeypatch):
    rows = spark.range(3_000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.array(
        *[F.sin(F.col("id") * k + k) for k in (1, 2, 3)]).cast("array<float>").alias("embedding"))
    asked = rows.limit(300).select(F.regexp_replace("chunk_id", "c", "q").alias("query_id"), F.col("embedding").alias("vector"))
    copies, match = [], vector._match_blocks

    def seen(chunks, queries, k):
        copies.append((chunks.count() // 3_000, queries.count() // 300))
        return match(chunks, queries, k)

    monkeypatch.setattr(vector, "_match_blocks", seen)
    found = vector.nearest(rows, asked, 4, block=7, query_block=3)
    assert copies == [(16, 16)]  # with a block of its own for each of 429 x 100, every row was written 100 or 429 times
    assert vector.nearest(rows, asked, 4).exceptAll(found).isEmpty() and found.count() == 1_200
