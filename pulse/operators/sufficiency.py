"""Does the game contain an item that closes a check's shortfall, and is it placed anywhere?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.scope import env_note, env_predicate, parse_scope
from pulse.functions.verdicts import (SURVEYABLE_TYPES, gate_verdict, is_remedy, reachability)
from pulse.operators.stats import opted_in

GATE = ("check_id", "stat", "stat_kind", "threshold")
DEFAULT_LIMIT, MAX_LIMIT = 100, 2000
TOP_REMEDIES = 6

NOT_SURVEYED_NOTE = ("No survey of placed items is loaded: whether a player can get any listed "
                     "remedy is unknown.")
SURVEYED_NOTE = ("Placement covers loose items and containers only. Goods for sale are not "
                 "surveyed, so NOT_PLACED does not mean out of reach.")


def gate_gaps(events: DataFrame, scope: str = "real") -> DataFrame:
    """Failed opted-in checks per gate, with the exact median and 90th percentile shortfall.

    `percentile_disc` keeps one counter per distinct gap, and gaps are small integers, so its
    partial state stays small however hot a gate is.
    """
    gap = F.col("threshold") - F.col("skill_value")
    failed = (opted_in(events).filter(~F.col("passed") & env_predicate(parse_scope(scope)))
              .withColumn("gap", gap).filter(F.col("gap") > 0))
    return failed.groupBy(*GATE).agg(
        F.count("*").alias("fails"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").cast("int").alias("gap_p50"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY gap)").cast("int").alias("gap_p90"))


def placement_tally(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("area", "is_exterior", "item_record_id").agg(
        F.sum("count").alias("count"))


def remedies(effects: DataFrame, records: DataFrame, placements: DataFrame) -> DataFrame:
    """Effects that can serve as a remedy, with the number of areas holding the item.

    Corpus ids are mixed case and survey ids lower case: the join goes through `lower`.
    """
    areas = placements.groupBy("item_record_id").agg(F.count("*").alias("areas"))
    typed = effects.join(records.select("record_id", "type", "name"), "record_id")
    return (typed.filter(is_remedy())
            .join(areas, F.lower("record_id") == F.col("item_record_id"), "left")
            .withColumn("placed_areas", F.coalesce("areas", F.lit(0)))
            .drop("item_record_id", "areas"))


def gate_counts(gates: DataFrame, remedy_rows: DataFrame) -> DataFrame:
    """Remedy counts per gate without ever pairing a gate with single remedies.

    Only three facts of a remedy matter: its magnitudes, whether it is placed, whether a survey
    could have seen it. Remedies collapse to a histogram over those (bounded by the integer
    magnitude range), gates to their distinct (stat, kind, p90) demands, and only these meet.
    """
    placed = F.col("placed_areas") > 0
    surveyable = F.col("type").isin(*SURVEYABLE_TYPES)
    cells = remedy_rows.groupBy(
        F.col("affected").alias("stat"), F.col("affected_kind").alias("stat_kind"),
        "magnitude_min", "magnitude_max", placed.alias("placed"), surveyable.alias("surveyable"),
    ).agg(F.count("*").alias("n"), F.sum("placed_areas").alias("areas"))
    demands = gates.select("stat", "stat_kind", "gap_p90").distinct()

    def total(value: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0))

    sure = F.col("magnitude_min") >= F.col("gap_p90")
    maybe = F.col("magnitude_max") >= F.col("gap_p90")
    supply = demands.join(cells, ["stat", "stat_kind"], "left").groupBy(
        "stat", "stat_kind", "gap_p90").agg(
        total("n", sure).alias("reliable"), total("n", maybe).alias("possible"),
        total("n", F.col("magnitude_min").isNull()).alias("unknown_magnitude"),
        total("n", maybe & F.col("placed")).alias("placed_remedies"),
        total("areas", maybe).alias("placed_areas"),
        total("n", maybe & F.col("surveyable")).alias("surveyable_possible"))
    return gates.join(supply, ["stat", "stat_kind", "gap_p90"]).select(
        *GATE, "fails", "gap_p50", "gap_p90", "reliable", "possible", "unknown_magnitude",
        "placed_remedies", "placed_areas", "surveyable_possible")


def classify(counts: DataFrame, surveyed: Column) -> DataFrame:
    """Verdict and reachability; without a survey the placement counts read 0."""
    return counts.withColumns({
        "verdict": gate_verdict(F.col("possible"), F.col("reliable")),
        "reachable": reachability(surveyed, F.col("surveyable_possible"),
                                  F.col("placed_remedies")),
        "placed_remedies": F.when(surveyed, F.col("placed_remedies")).otherwise(0),
        "placed_areas": F.when(surveyed, F.col("placed_areas")).otherwise(0)})


def sufficiency(events: DataFrame, effects: DataFrame, records: DataFrame, placements: DataFrame,
                surveys: DataFrame, scope: str = "real") -> DataFrame:
    """All gates with verdicts. `surveyed` is a one-row scalar: any survey header at all."""
    gates = gate_gaps(events, scope)
    counts = gate_counts(gates, remedies(effects, records, placements))
    any_survey = surveys.limit(1).agg((F.count("*") > 0).alias("surveyed"))
    return classify(counts.crossJoin(F.broadcast(any_survey)), F.col("surveyed"))


def worst_gates(classified: DataFrame, limit: int | None = None) -> DataFrame:
    """Most failed first, with a full tie-break; 0 asks for counts only."""
    n = DEFAULT_LIMIT if limit is None else min(max(int(limit), 0), MAX_LIMIT)
    return classified.orderBy(F.desc("fails"), *[F.asc_nulls_last(k) for k in GATE]).limit(n)


def envelope(classified: DataFrame, scope: str = "real") -> DataFrame:
    """One summary row: totals before any limit, and the provenance notes."""
    n = F.count("*")
    verdicts = [F.count_if(F.col("verdict") == v).alias(v)
                for v in ("remedy_exists", "gamble_only", "no_remedy")]
    any_survey = F.coalesce(F.bool_or("surveyed"), F.lit(False))
    return classified.agg(
        n.alias("total_gates"), *verdicts, any_survey.alias("surveyed"),
        F.when(any_survey, SURVEYED_NOTE).otherwise(NOT_SURVEYED_NOTE).alias("reachability_note"),
    ).withColumns({"env_scope": F.lit(parse_scope(scope)), "env_note": F.lit(env_note(scope))})


def top_remedies(gates: DataFrame, remedy_rows: DataFrame, k: int = TOP_REMEDIES) -> DataFrame:
    """Strongest `k` sufficient remedies per gate.

    "Strong enough" is a cut along the very order they are ranked by, so the best k per stat,
    cut at the gate's p90, are the best k of the gate: one bounded top-k per stat, no pairs.
    """
    strongest = Window.partitionBy("affected", "affected_kind").orderBy(
        F.desc_nulls_last("magnitude_max"), F.asc("record_id"), F.asc("ordinal"))
    best = (remedy_rows.filter(F.col("magnitude_max").isNotNull())
            .withColumn("rank", F.row_number().over(strongest)).filter(F.col("rank") <= k)
            .select(F.col("affected").alias("stat"), F.col("affected_kind").alias("stat_kind"),
                    "rank", "record_id", F.coalesce("name", "record_id").alias("name"), "type",
                    "magnitude_min", "magnitude_max"))
    return gates.select(*GATE, "gap_p90").join(best, ["stat", "stat_kind"]).filter(
        F.col("magnitude_max") >= F.col("gap_p90"))


def match_gate(gates: DataFrame, keys: DataFrame) -> DataFrame:
    """Requested gate keys that exist, on all four fields; a near match is no match."""
    return keys.select(*GATE).distinct().join(gates, list(GATE))
