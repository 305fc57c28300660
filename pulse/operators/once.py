"""Keep costly expressions from being computed more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of recomputing.

    A filter on a derived column is pushed below its projection together with a copy of the
    expression; with a parser or a chain of regular expressions that multiplies the work. A
    one-element explode keeps the value where it is computed, inside the same stage.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.explode(F.array(row)).alias("_once")).select(
        *df.columns, *[F.col(f"_once.{name}").alias(name) for name in columns])
