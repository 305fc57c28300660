"""Decision ladders: what happened next, how far off, is there a remedy, is it reachable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Retired event types. They must leave the stream before any "next event" is taken.
RETIRED_TYPES = ("Heartbeat", "SpikeStarted")
SURVEYABLE_TYPES = ("ALCH", "INGR")
# Buckets of `next_action` with their own column in the stacked view; the rest folds to `other`.
NAMED_ACTIONS = ("retried_same", "exited_solved", "switched_topic", "abandoned", "session_end")
BAND_ORDER = ("near_miss", "moderate_gap", "build_gap")


def live_types(type_col: Column | None = None) -> Column:
    return ~(F.col("type") if type_col is None else type_col).isin(*RETIRED_TYPES)


def next_action(suspect: Column, topic: Column, nxt: Column) -> Column:
    """Bucket what followed a failed attempt, for batch and fold; the stream's state machine has the
    same ladder for one pair of events (`streaming.settle.bucket`), held equal by a test.

    A null suspect or topic compares as unknown, so it cannot read as a retry of the same topic.
    """
    kind = nxt["type"]
    attempt = kind == "ConfrontationAttempted"
    exited = kind == "ConfrontationExited"
    same = (nxt["suspect"] == suspect) & (nxt["topic"] == topic)
    return (F.when(kind.isNull(), "session_end")
            .when(attempt & same, "retried_same")
            .when(attempt, "switched_topic")
            .when(exited & nxt["completed"], "exited_solved")
            .when(exited, "abandoned")
            .when(kind == "AreaEntered", "left_area")
            .otherwise("other"))


def margin_band(margin: Column) -> Column:
    return (F.when(margin >= -10, "near_miss").when(margin >= -15, "moderate_gap")
            .otherwise("build_gap"))


def band_rank(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BAND_ORDER]), band)


def fluke(passed: Column, threshold_passed: Column) -> Column:
    """The player saw a pass that the numbers did not earn."""
    return passed & ~threshold_passed


def gate_verdict(possible: Column, reliable: Column) -> Column:
    return (F.when(possible == 0, "no_remedy").when(reliable == 0, "gamble_only")
            .otherwise("remedy_exists"))


def reachability(surveyed: Column, surveyable_possible: Column, placed: Column) -> Column:
    """Absence of a survey is not a finding: it stays UNKNOWN."""
    return (F.when(~surveyed | (surveyable_possible == 0), "UNKNOWN")
            .when(placed > 0, "PLACED").otherwise("NOT_PLACED"))


def is_remedy() -> Column:
    """Effects that raise a stat; constant-effect spells (duration 0) are not usable remedies.

    Three-valued on purpose: a spell of unknown duration is dropped, other types are kept.
    """
    return (F.col("effect_name").ilike("fortify%") & F.col("affected").isNotNull()
            & ~((F.col("type") == "SPEL") & (F.col("duration") == 0)))
