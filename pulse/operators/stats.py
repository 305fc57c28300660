"""Grouped statistics over the event log: attempts, checks, coverage, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions import payload
from pulse.functions.scope import low_confidence
from pulse.functions.verdicts import band_rank, fluke, margin_band
from pulse.session import stored

PRIOR_STRENGTH = 10


def attempts(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type") == "ConfrontationAttempted")


def checks(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type") == "SkillCheckResolved")


def opted_in(events: DataFrame) -> DataFrame:
    """Skill checks the player chose to take; passive ones carry no frustration signal."""
    return checks(events).filter(F.col("trigger") == "inspect")


def rate(flag: Column, places: int = 3) -> Column:
    return F.round(F.avg(flag.cast("int")), places)


# ---- confrontations --------------------------------------------------------------------------

def by_topic(events: DataFrame) -> DataFrame:
    return attempts(events).groupBy("suspect", "topic").agg(
        F.count("*").alias("attempts"), F.count_if("passed").alias("passes"),
        rate(F.col("passed")).alias("pass_rate"))


def by_reason(events: DataFrame) -> DataFrame:
    return attempts(events).filter(~F.col("passed")).groupBy("reason").agg(
        F.count("*").alias("count"))


def overall(events: DataFrame) -> DataFrame:
    """One row of totals; the rate is 0 rather than an error when nothing was attempted."""
    totals = attempts(events).agg(F.count("*").alias("attempts"),
                                  F.count_if("passed").alias("passes"))
    return totals.withColumn("pass_rate", F.when(
        F.col("attempts") > 0, F.round(F.try_divide("passes", "attempts"), 3)).otherwise(0.0))


def stuck_ranking(topics: DataFrame, prior: int = PRIOR_STRENGTH) -> DataFrame:
    """Shrink each fail rate toward the global one, then weight by log volume.

    The global rate is a one-row aggregate of the already grouped topics. Scores are rounded
    before they are sorted, so equal scores fall to the tie-break.
    """
    fails = F.col("attempts") - F.col("passes")
    prior_rate = topics.agg(F.coalesce(F.try_divide(F.sum(fails), F.sum("attempts")), F.lit(0.0))
                            .alias("global_fail_rate"))
    n = F.col("attempts")
    shrunk = (fails + prior * F.col("global_fail_rate")) / (n + prior)
    weight = F.when(n > 0, F.ln(n)).otherwise(0.0)
    raw = F.coalesce(F.try_divide(fails, n), F.lit(0.0))
    # the right side is a global aggregate: exactly one row
    return topics.crossJoin(F.broadcast(prior_rate)).select(
        "suspect", "topic", "attempts", fails.alias("fails"),
        F.round(raw, 4).alias("raw_fail_rate"), F.round(shrunk, 4).alias("shrunk_fail_rate"),
        F.round(weight, 4).alias("volume_weight"), F.round(shrunk * weight, 4).alias("stuck_score"),
        F.round("global_fail_rate", 4).alias("global_fail_rate"),
        low_confidence(n).alias("low_confidence"))


def in_ranking_order(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.desc("stuck_score"), F.desc("attempts"),
                          F.asc_nulls_last("suspect"), F.asc_nulls_last("topic"))


# ---- skill checks ------------------------------------------------------------------------------

def by_check(events: DataFrame) -> DataFrame:
    margin = F.col("skill_value") - F.col("threshold")
    short = F.when(~F.col("threshold_passed"), margin)
    return opted_in(events).groupBy("check_id", "stat", "stat_kind").agg(
        F.count("*").alias("attempts"), F.count_if("threshold_passed").alias("passes"),
        rate(F.col("threshold_passed")).alias("pass_rate"),
        F.count_if(fluke(F.col("passed"), F.col("threshold_passed"))).alias("fluke_passes"),
        F.round(F.avg(short), 1).alias("avg_fail_margin"),
        F.max(short).alias("closest_fail_margin"), F.min(short).alias("worst_fail_margin"))


def failure_distance(events: DataFrame) -> DataFrame:
    """One vote per (session, check): its best margin, and only if it never cleared the bar."""
    margin = F.col("skill_value") - F.col("threshold")
    unsolved = (opted_in(events).groupBy("session_id", "check_id")
                .agg(F.max(margin).alias("margin"),
                     F.bool_or("threshold_passed").alias("cleared"))
                .filter(~F.col("cleared")))
    return (unsolved.groupBy(margin_band(F.col("margin")).alias("band"))
            .agg(F.count("*").alias("count"), F.round(F.avg("margin"), 1).alias("avg_margin"))
            .withColumn("band_rank", band_rank(F.col("band"))))


def stat_coverage(events: DataFrame) -> DataFrame:
    """What the content tests; passive checks count here."""
    return checks(events).groupBy("stat", "stat_kind", "trigger").agg(
        F.count("*").alias("checks"), F.count_distinct("check_id").alias("distinct_checks"),
        rate(F.col("threshold_passed")).alias("pass_rate"))


def routes_taken(events: DataFrame, has_route: Column) -> DataFrame:
    """`has_route` is payload key existence, so a route of JSON null is still counted."""
    return checks(events).filter(has_route & F.col("threshold_passed")).groupBy(
        F.col("skill_route").alias("route")).agg(F.count("*").alias("passes"))


def collapse_checks(checks_by_stat: DataFrame, label_prefix: str = "") -> DataFrame:
    """One row per check: its closest miss. Variants are counted, attempts are never summed."""
    best_first = Window.partitionBy("check_id").orderBy(
        F.desc("closest_fail_margin"), F.desc("attempts"), F.asc("stat"), F.asc("stat_kind"))
    # the input is already grouped, so a check has one row per stat it was tested against
    return (checks_by_stat.filter(F.col("closest_fail_margin").isNotNull())
            .withColumn("rn", F.row_number().over(best_first))
            .withColumn("variants", F.count("*").over(Window.partitionBy("check_id")))
            .filter(F.col("rn") == 1)
            .select("check_id", payload.check_label(F.col("check_id"), label_prefix)
                    .alias("label"), F.col("closest_fail_margin").alias("margin"), "stat",
                    "stat_kind", "attempts", "variants"))


# ---- volume ------------------------------------------------------------------------------------

def counts_by(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("events"))


def mods_list(events: DataFrame, mods: DataFrame) -> DataFrame:
    """Every known mod with its volume, including mods that sent nothing."""
    seen = events.groupBy("mod_id").agg(F.count("*").alias("events"),
                                        F.count_distinct("session_id").alias("sessions"))
    return mods.join(seen, "mod_id", "left").select(
        *mods.columns, F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"))


def quantiles_disc(values: DataFrame, keys: list[str], value: str,
                   shares: dict[str, float]) -> DataFrame:
    """Exact discrete quantiles from a value histogram.

    Rows are first counted per distinct value with map-side partial sums. The histogram is then dealt by
    range of (keys, value), so the values of one key, or of no key at all, lie in many ranges; totals of
    ranges tell which of them hold a rank, and only those are searched. A window never spans more than
    one range of a key, or one row for each of its ranges.
    """
    histogram = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = stored(histogram.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "histogram")
    ranges = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rows"), F.max(value).alias("_max"))
    own = Window.partitionBy(*keys)
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_total": F.sum("_rows").over(own)})

    def rank(share: float):
        return F.col("_total") * share

    holds = F.lit(False)
    for share in shares.values():
        holds = holds | ((F.col("_before") < rank(share)) & (F.col("_before") + F.col("_rows") >= rank(share)))
    asked = ranges.filter(holds).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_at"), "_before", "_total")
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy(F.asc(value)))
    inside = placed.join(asked, same).withColumn("_upto", F.col("_before") + upto)
    picks = inside.groupBy(*keys).agg(*[
        F.min(F.when((F.col("_before") < rank(share)) & (F.col("_upto") >= rank(share)), F.col(value))).alias(name)
        for name, share in shares.items()])
    whole = ranges.groupBy(*keys).agg(F.sum("_rows").alias("n"), F.max("_max").alias("max"))
    whole = whole.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "max")
    if not keys:
        return picks.crossJoin(F.broadcast(whole)).select("n", *shares, "max")  # one row each
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return picks.join(whole, same).select(*keys, "n", *shares, "max")


def session_sizes(events: DataFrame) -> DataFrame:
    sizes = events.groupBy("session_id").agg(F.count("*").alias("size"))
    return quantiles_disc(sizes, [], "size", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).select(
        F.lit("all").alias("scope"), F.col("n").alias("sessions"), "p50", "p90", "p99", "max")
