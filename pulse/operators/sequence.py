"""What happened next, and how many tries it took: order-sensitive analysis of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.verdicts import NAMED_ACTIONS, live_types, next_action
from pulse.operators.blocked import BLOCK, lead_struct
from pulse.operators.stats import attempts

PARTIAL_KEYS = ("suspect", "topic", "next_action")


def failed_with_next(events: DataFrame) -> DataFrame:
    """Failed attempts with the bucket of what followed and the gap to it in microseconds.

    Retired types leave before the window; failures are selected after it. Swapping either
    would turn "next event" into "next heartbeat" or "next failure".
    """
    stream = events.filter(live_types()).withColumn("ts_us", F.unix_micros("ts"))
    paired = lead_struct(stream, ["session_id"], "seq",
                         ["type", "suspect", "topic", "completed", "ts_us"])
    return (paired.filter((F.col("type") == "ConfrontationAttempted") & ~F.col("passed"))
            .withColumns({
                "next_action": next_action(F.col("suspect"), F.col("topic"), F.col("nxt")),
                "gap_us": F.col("nxt.ts_us") - F.col("ts_us")})
            .drop("nxt"))


def after_failure_partials(events: DataFrame, *extra: str) -> DataFrame:
    """Additive parts only: averages cannot be merged, sums and counts can."""
    return failed_with_next(events).groupBy(*extra, *PARTIAL_KEYS).agg(
        F.count("*").alias("count"), F.count("gap_us").alias("gap_count"),
        F.coalesce(F.sum("gap_us"), F.lit(0)).alias("sum_gap_us"))


def after_failure(partials: DataFrame) -> DataFrame:
    """Merge partials from any number of folds and derive the average once, at the end."""
    merged = partials.groupBy(*PARTIAL_KEYS).agg(
        F.sum("count").alias("count"), F.sum("gap_count").alias("gap_count"),
        F.sum("sum_gap_us").alias("sum_gap_us"))
    return merged.select(*PARTIAL_KEYS, "count", F.round(
        F.try_divide(F.col("sum_gap_us") / 1e6, "gap_count"), 1).alias("avg_gap_seconds"))


def after_failure_pivot(stats: DataFrame) -> DataFrame:
    """One row per topic, one column per named bucket; anything unnamed is shown as `other`."""
    action = F.col("next_action")
    named = [F.coalesce(F.sum(F.when(action == a, F.col("count"))), F.lit(0)).alias(a)
             for a in NAMED_ACTIONS]
    rest = F.coalesce(F.sum(F.when(~action.isin(*NAMED_ACTIONS), F.col("count"))), F.lit(0))
    return stats.groupBy("suspect", "topic").agg(*named, rest.alias("other"),
                                                 F.sum("count").alias("total"))


def session_attempts(events: DataFrame, keys: tuple[str, ...] = ("suspect", "topic")) -> DataFrame:
    """Per (session, subject): tries, and tries up to the first success (null = never solved).

    Two levels: number the tries inside a block, then add the tries of earlier blocks. The second
    window sees one row per block, so even an endless session is never gathered in one task.
    """
    group = ["session_id", *keys]
    inside = Window.partitionBy(*group, BLOCK).orderBy(F.asc("seq"))
    blocks = (events.withColumn("_no", F.row_number().over(inside))
              .groupBy(*group, BLOCK)
              .agg(F.first("install_id", ignorenulls=True).alias("install_id"),
                   F.count("*").alias("_n"), F.min(F.when(F.col("passed"), F.col("_no")))
                   .alias("_first")))
    before = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .groupBy(*group)
            .agg(F.first("install_id").alias("install_id"),
                 F.sum("_n").alias("total_attempts"),
                 F.min(F.col("_first") + F.col("_before")).alias("attempts_to_pass")))


def confrontation_attempts(events: DataFrame) -> DataFrame:
    return session_attempts(attempts(events))


def attempts_to_pass(per_session: DataFrame) -> DataFrame:
    return per_session.groupBy("suspect", "topic").agg(
        F.count("*").alias("sessions"), F.count("attempts_to_pass").alias("solved_sessions"),
        F.sum("total_attempts").alias("total_attempts"),
        F.round(F.avg("attempts_to_pass"), 2).alias("avg_attempts_to_pass"),
        F.max("total_attempts").alias("max_attempts_in_a_session"))


def unpassable(topic_stats: DataFrame, at_least: int) -> DataFrame:
    """Nobody solved it, and enough tries were made for that to mean something."""
    return topic_stats.filter((F.col("solved_sessions") == 0)
                              & (F.col("total_attempts") >= at_least))


def comeback(per_session: DataFrame) -> DataFrame:
    """Installs that failed in one session and won in another."""
    per_install = per_session.groupBy("install_id", "suspect", "topic").agg(
        F.bool_or(F.col("attempts_to_pass").isNotNull()).alias("solved"),
        F.bool_or(F.col("attempts_to_pass").isNull()).alias("unsolved"))
    return per_install.groupBy("suspect", "topic").agg(
        F.count_if(F.col("solved") & F.col("unsolved")).alias("came_back_and_won"),
        F.count_if(F.col("unsolved") & ~F.col("solved")).alias("never_solved_any_session"),
        F.count("*").alias("installs"))
