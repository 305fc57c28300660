"""Ordered-window operators that never need a whole key in one task.

`Window.partitionBy("session_id")` sends every event of a session to one task, so a single hot
session (a soak-test bot, a client stuck in a loop) decides how long the job runs. Events therefore
carry a `block` column next to the order column: blocks of one key are consecutive slices of its
order, small enough to sort in one task. Each operator here

1. runs the ordinary window inside `(key, block)`, and
2. repairs the edges between blocks with a summary that has one row per block.

Block 0 is where keys of ordinary size live entirely. The repair plans start from `block > 0`, so
for ordinary data they read nothing through the shuffle and adaptive execution drops their joins.
Keys must be non-null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "block"
# Rows per block: one sorted slice, a few tens of MB of event structs.
BLOCK_ROWS = 50_000


def with_block(df: DataFrame, order: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """Derive the block from a dense per-key sequence number (done once, at the silver write)."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(rows)).cast("long"))


def lead_struct(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str],
                out: str = "nxt") -> DataFrame:
    """Add struct `out` with `fields` of the next row of the key (null on the key's last row).

    Leads one narrow struct rather than whole rows. Edge repair: the first row of every later
    block is handed to the block before it.
    """
    keys = list(keys)
    row = F.struct(*[F.col(f) for f in fields])
    inside = df.withColumn(
        out, F.lead(row).over(Window.partitionBy(*keys, BLOCK).orderBy(F.asc(order))))
    heads = (df.filter(F.col(BLOCK) > 0)
             .groupBy(*keys, BLOCK).agg(F.min_by(row, F.col(order)).alias("_head")))
    per_key = Window.partitionBy(*keys).orderBy(BLOCK)
    seams = heads.select(
        *keys, F.coalesce(F.lag(BLOCK).over(per_key), F.lit(0)).cast("long").alias(BLOCK), "_head")
    return (inside.join(seams, [*keys, BLOCK], "left")
            .withColumn(out, F.coalesce(F.col(out), F.col("_head"))).drop("_head"))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                out: str) -> DataFrame:
    """1-based row number of each row within its key, counted across blocks."""
    keys = list(keys)
    inside = df.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*order)))
    spilled = df.filter(F.col(BLOCK) > 0).select(*keys).distinct()
    sizes = df.join(spilled, keys, "left_semi").groupBy(*keys, BLOCK).agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*keys).orderBy(BLOCK)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, BLOCK, F.sum("_n").over(before).alias("_offset"))
    return (inside.join(offsets, [*keys, BLOCK], "left")
            .withColumn(out, F.col(out) + F.coalesce(F.col("_offset"), F.lit(0))).drop("_offset"))


def carry_last(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column],
               inclusive: bool = False) -> DataFrame:
    """Add each column of `values`: its last non-null value at earlier rows of the key.

    `inclusive` counts the row itself as earlier. All values share one pass.
    """
    keys = list(keys)
    df = df.withColumns({f"_{name}": value for name, value in values.items()})
    window = (Window.partitionBy(*keys, BLOCK).orderBy(F.asc(order))
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    inside = df.withColumns({name: F.last(f"_{name}", ignorenulls=True).over(window)
                             for name in values})
    spilled = df.filter(F.col(BLOCK) > 0).select(*keys).distinct()
    # a bounded summary per block: its last non-null values
    tails = (df.join(spilled, keys, "left_semi").groupBy(*keys, BLOCK)
             .agg(*[F.max_by(f"_{name}", F.when(F.col(f"_{name}").isNotNull(), F.col(order)))
                    .alias(name) for name in values]))
    before = (Window.partitionBy(*keys).orderBy(BLOCK)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = tails.select(*keys, BLOCK, *[F.last(name, ignorenulls=True).over(before)
                                           .alias(f"_carry_{name}") for name in values])
    joined = inside.join(carried, [*keys, BLOCK], "left")
    return joined.withColumns({name: F.coalesce(name, f"_carry_{name}") for name in values}).drop(
        *[f"_{name}" for name in values], *[f"_carry_{name}" for name in values])


def dense_sequence(df: DataFrame, key: str, ts: str, tie: str, out: str = "seq",
                   hot_rows: int = 1_000_000) -> DataFrame:
    """Number rows 0.. per key by `(ts, tie)` and attach `block`, for feeds that carry no `seq`.

    Keys above `hot_rows` are cut into one-minute blocks and numbered block by block; all others
    stay in block 0. At most total_rows / hot_rows keys can be hot, which bounds the broadcasts
    (a million keys per 10^12 rows). Sizes are counted with map-side partial aggregation. The two
    kinds are separate branches, so for ordinary data the second one vanishes at run time.
    """
    hot = F.broadcast(df.groupBy(key).agg(F.count("*").alias("_rows"))
                      .filter(F.col("_rows") > hot_rows).select(key))
    order = [F.asc(ts), F.asc(tie)]
    cold = df.join(hot, key, "left_anti").withColumn(BLOCK, F.lit(0).cast("long"))
    cold = cold.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    minute = F.floor(F.unix_micros(F.col(ts)) / F.lit(60_000_000)).cast("long")
    cut = df.join(hot, key).withColumn(BLOCK, minute)
    inside = cut.withColumn(
        out, F.row_number().over(Window.partitionBy(key, BLOCK).orderBy(*order)))
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(key, BLOCK).agg(F.count("*").alias("_n")).select(
        key, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    counted = inside.join(offsets, [key, BLOCK]).withColumn(out, F.col(out) + F.col("_offset"))
    return (cold.unionByName(counted.select(*cold.columns))
            .withColumn(out, (F.col(out) - 1).cast("long")))
