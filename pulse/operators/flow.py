"""Flow, discovery and approach questions: gaps, drop-off, revisits, returns, funnels, shares."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.verdicts import live_types
from pulse.operators.blocked import carry_last, dense_sequence, lead_struct, number_rows
from pulse.operators.stats import quantiles_disc


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Missing sequence numbers per session: events that were emitted and never arrived."""
    paired = lead_struct(events.select("session_id", "seq", "block"), ["session_id"], "seq",
                         ["seq"])
    missing = F.coalesce(F.col("nxt.seq") - F.col("seq") - 1, F.lit(0))
    return paired.groupBy("session_id").agg(
        F.count("*").alias("events"), F.sum(missing).alias("missing"),
        F.count_if(missing > 0).alias("gaps"))


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "type").agg(
        F.count("*").alias("events"))


def lateness(events: DataFrame) -> DataFrame:
    """Seconds between happening and arriving, as exact quantiles by hour and environment."""
    seconds = F.round((F.unix_micros("received_at") - F.unix_micros("ts")) / 1e6).cast("long")
    rows = events.select("env", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"),
                         seconds.alias("late"))
    return quantiles_disc(rows, ["env", "hour"], "late", {"p50": 0.5, "p90": 0.9})


def drop_off(events: DataFrame) -> DataFrame:
    """Last observed activity and last area of each session, counted. One aggregate, no sort."""
    last = events.filter(live_types()).groupBy("session_id").agg(
        F.max_by("type", "seq").alias("last_type"),
        F.max_by("area", F.when(F.col("area").isNotNull(), F.col("seq"))).alias("last_area"))
    return last.groupBy("last_type", "last_area").agg(F.count("*").alias("sessions"))


def area_visits(events: DataFrame) -> DataFrame:
    """Area entries with visit number within the session and time until the next entry."""
    entered = (events.filter(F.col("type") == "AreaEntered")
               .select("session_id", "seq", "block", "area", F.unix_micros("ts").alias("ts_us")))
    paired = lead_struct(entered, ["session_id"], "seq", ["ts_us"])
    numbered = number_rows(paired, ["session_id", "area"], [F.asc("seq")], "visit_no")
    return numbered.withColumn("dwell_us", F.col("nxt.ts_us") - F.col("ts_us")).drop("nxt")


def area_revisits(events: DataFrame) -> DataFrame:
    return area_visits(events).groupBy("area").agg(
        F.count("*").alias("visits"), F.count_if(F.col("visit_no") > 1).alias("revisits"),
        F.round(F.try_divide(F.sum("dwell_us") / 1e6, F.count("dwell_us")), 1)
        .alias("avg_dwell_seconds"))


def returns(events: DataFrame) -> DataFrame:
    """Sessions per install and the breaks between them."""
    bounds = events.groupBy("install_id", "session_id").agg(F.min("ts").alias("started"),
                                                            F.max("ts").alias("ended"))
    ordered = dense_sequence(bounds, "install_id", "started", "session_id").withColumns({
        "start_us": F.unix_micros("started"), "end_us": F.unix_micros("ended")})
    paired = lead_struct(ordered, ["install_id"], "seq", ["start_us"])
    gap = F.col("nxt.start_us") - F.col("end_us")
    return paired.groupBy("install_id").agg(
        F.count("*").alias("sessions"), F.round(F.sum(gap) / 3.6e9, 3).alias("total_break_hours"),
        F.round(F.max(gap) / 3.6e9, 3).alias("longest_break_hours"))


def funnel(events: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Installs reaching each milestone in order, and mean seconds from the one before."""
    names = list(steps)
    firsts = events.groupBy("install_id").agg(
        *[F.min(F.when(cond, F.unix_micros("ts"))).alias(name) for name, cond in steps.items()])
    reached = F.lit(True)
    rows = []
    for i, name in enumerate(names):
        reached = reached & F.col(name).isNotNull()
        if i:
            reached = reached & (F.col(name) >= F.col(names[i - 1]))
        waited = (F.col(name) - F.col(names[i - 1])) if i else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"),
                             F.coalesce(reached, F.lit(False)).alias("ok"),
                             waited.alias("waited")))
    exploded = firsts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("ok")
    return exploded.groupBy("step_no", "step").agg(
        F.count("*").alias("installs"),
        F.round(F.try_divide(F.sum("waited") / 1e6, F.count("waited")), 1)
        .alias("avg_seconds_from_previous"))


def discovery(manifest: DataFrame, seen_counts: DataFrame, key: str) -> DataFrame:
    """Exposure of everything that exists, zeroes included."""
    return manifest.select(key).join(seen_counts, key, "left").select(
        key, F.coalesce("seen", F.lit(0)).alias("seen"))


def engagement(events: DataFrame) -> DataFrame:
    """Of installs shown a fact or pattern topic, how many argued it. One grouped pass."""
    shown = (F.col("type") == "ConfrontationTopicEntered") & F.col("kind").isin("fact", "pattern")
    tried = F.col("type") == "ConfrontationAttempted"
    per_install = (events.filter(shown | tried).groupBy("install_id", "suspect", "topic")
                   .agg(F.bool_or(shown).alias("exposed"), F.bool_or(tried).alias("engaged"))
                   .filter("exposed"))
    return per_install.groupBy("suspect", "topic").agg(
        F.count("*").alias("exposed"), F.count_if("engaged").alias("engaged"),
        F.round(F.avg(F.col("engaged").cast("int")), 3).alias("engaged_share"))


def evidence_possession(events: DataFrame) -> DataFrame:
    """Did a failed attempt lack its evidence (discovery problem) or have it (reasoning problem)?

    Discoveries collapse to one row per (install, evidence) before the join, so the join adds
    one row per required evidence and no more.
    """
    found = (events.filter(F.col("type") == "EvidenceCollected")
             .groupBy("install_id", "evidence_id").agg(F.min("ts").alias("found_at")))
    failed = (events.filter((F.col("type") == "ConfrontationAttempted") & ~F.col("passed"))
              .select("install_id", "session_id", "seq", "ts", "suspect", "topic",
                      F.explode(F.array_distinct("evidence_ids")).alias("evidence_id")))
    held = failed.join(found, ["install_id", "evidence_id"], "left").withColumn(
        "held", F.coalesce(F.col("found_at") < F.col("ts"), F.lit(False)))
    per_attempt = held.groupBy("session_id", "seq", "suspect", "topic").agg(
        F.bool_and("held").alias("had_all"))
    return per_attempt.groupBy("suspect", "topic", F.when(F.col("had_all"), "reasoning")
                               .otherwise("discovery").alias("problem")).agg(
        F.count("*").alias("failed_attempts"))


def declined_checks(events: DataFrame) -> DataFrame:
    """Displays not followed by a resolve of the same check, by whether the bar was met.

    Group size is the number of displays sharing the group, never a maximum of the group number,
    which is not dense.
    """
    stream = events.filter(F.col("type").isin("SkillCheckDisplayed", "SkillCheckResolved"))
    paired = lead_struct(stream, ["session_id", "check_id"], "seq", ["type"])
    shown = paired.filter(F.col("type") == "SkillCheckDisplayed").withColumn(
        "declined", F.coalesce(F.col("nxt.type") != "SkillCheckResolved", F.lit(True)))
    # sizes come from partial counts joined back, so a hot group is never gathered
    sizes = shown.groupBy("session_id", "display_group").agg(F.count("*").alias("group_size"))
    return (shown.join(sizes, ["session_id", "display_group"])
            .groupBy("threshold_met", "group_size")
            .agg(F.count("*").alias("displayed"), F.count_if("declined").alias("declined"),
                 F.round(F.avg(F.col("declined").cast("int")), 3).alias("declined_share")))


def share_within(rows: DataFrame, keys: list[str], value: str, over: list[str]) -> DataFrame:
    """Count per key and its share of the total over `over`; the window sees grouped rows only."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias(value))
    total = F.sum(value).over(Window.partitionBy(*over))
    return counts.withColumn("share", F.round(F.col(value) / total, 3))


def solution_share(events: DataFrame) -> DataFrame:
    """Which stat solved a check, for checks solved by more than one."""
    solved = events.filter((F.col("type") == "SkillCheckResolved") & F.col("threshold_passed"))
    shares = share_within(solved, ["check_id", "stat"], "passes", ["check_id"])
    routes = F.count("*").over(Window.partitionBy("check_id"))
    return shares.withColumn("routes", routes).filter(F.col("routes") > 1)


def completion_by_route(events: DataFrame) -> DataFrame:
    """Sessions that passed by a route, and how many of them also finished a confrontation."""
    used = F.when((F.col("type") == "SkillCheckResolved") & F.col("threshold_passed"),
                  F.col("skill_route"))
    done = F.coalesce((F.col("type") == "ConfrontationExited") & F.col("completed"), F.lit(False))
    sessions = events.groupBy("session_id").agg(
        F.collect_set(used).alias("routes"),  # routes are a handful of names
        F.bool_or(done).alias("completed"))
    return sessions.select(F.explode("routes").alias("route"), "completed").groupBy("route").agg(
        F.count("*").alias("sessions"), F.count_if("completed").alias("completed_sessions"),
        F.round(F.avg(F.col("completed").cast("int")), 3).alias("completion_rate"))


def boosted_passes(events: DataFrame) -> DataFrame:
    """Passes that a boost decided (base < threshold <= value), by the last item consumed."""
    relevant = events.filter(F.col("type").isin("ItemConsumed", "SkillCheckResolved"))
    carried = carry_last(relevant, ["session_id"], "seq", {"last_item": F.col("item_id")})
    passes = carried.filter((F.col("type") == "SkillCheckResolved")
                            & (F.col("skill_value") >= F.col("threshold")))
    boosted = F.col("base_value") < F.col("threshold")
    return passes.groupBy("last_item").agg(
        F.count("*").alias("passes"), F.count_if(boosted).alias("boosted_passes"),
        F.round(F.avg(boosted.cast("int")), 3).alias("boosted_share"))


def consumed_effects(events: DataFrame, records: DataFrame, effects: DataFrame) -> DataFrame:
    """What consumed items do. Consumption is counted per item before it meets the corpus."""
    eaten = (events.filter(F.col("type") == "ItemConsumed").groupBy("item_id")
             .agg(F.count("*").alias("consumed")))
    items = eaten.join(records.select("record_id", "type"),
                       F.lower("record_id") == F.col("item_id"))
    return items.join(effects, "record_id").select(
        "item_id", "record_id", "type", "consumed", "ordinal", "effect_name", "affected",
        "affected_kind", "magnitude_min", "magnitude_max")


def area_content(events: DataFrame, placements: DataFrame) -> DataFrame:
    """Visits of an area next to what lies in it; both sides grouped before the join."""
    visits = (events.filter(F.col("type") == "AreaEntered").groupBy("area")
              .agg(F.count("*").alias("visits")))
    content = placements.groupBy("area").agg(F.count("*").alias("items"),
                                             F.sum("count").alias("objects"))
    return visits.join(content, "area")
