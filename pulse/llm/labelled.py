"""The bounded sample of labelled documents that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 5000  # labelled rows at most
LONGEST = 1 << 16  # bytes; a longer text is scored but not fitted on


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` documents that are not held out, picked by a hash of the id.

    At most ``rows`` texts of at most LONGEST bytes come to the driver.
    """
    picked = (labels.select(labels["doc_id"].cast("long").alias("__id"), labels[label].cast("int").alias("__label"))
              .filter(F.col("__id").isNotNull() & F.col("__label").isNotNull() & ~held_out(F.col("__id")))
              .groupBy("__id").agg(F.max("__label").alias("__label"))
              .orderBy(F.xxhash64("__id"), "__id").limit(rows))
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= LONGEST)
    found = short.join(F.broadcast(picked), short["doc_id"] == F.col("__id")).select("doc_id", "text", "__label").toArrow()
    order = found.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return list(zip(order.column("text").to_pylist(), order.column("__label").to_pylist()))
