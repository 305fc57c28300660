"""Registered queries: settled sessions, fold parts, and the hybrid read."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulse.operators import sequence
from pulse.plans import rollup
from pulse.plans.catalog import query
from pulse.plans.eventlog import EventLog
from pulse.plans.queries_stats import AFTER, ATTEMPTS, NEXT, TO_PASS
from pulse.plans.twin import TELEMETRY, sql
from pulse.plans.versions import Versions
from pulse.session import scratch_path, stored

AS_OF = datetime(2024, 1, 20)
SETTLED = """
settled AS (
  SELECT session_id FROM telemetry GROUP BY ALL
  HAVING max(received_us) < epoch_us(TIMESTAMP '2024-01-20') - 600000000)"""


def settled(t):
    return rollup.settled(t.unordered(), F.lit(AS_OF)).select("session_id")


@query("settled_sessions", sql(TELEMETRY, SETTLED, body=" SELECT * FROM settled"))
def _(t):
    return settled(t)


@query("fold_partials", sql(TELEMETRY, SETTLED, NEXT, body="""
SELECT env, mod_id, suspect, topic, next_action, count(*) AS count, count(gap_us) AS gap_count,
  CAST(coalesce(sum(gap_us), 0) AS BIGINT) AS sum_gap_us
FROM fails WHERE session_id IN (SELECT session_id FROM settled) GROUP BY ALL"""))
def _(t):
    return sequence.after_failure_partials(rollup.only(t.telemetry(), settled(t)), *rollup.GRAIN)


@query("fold_attempts", sql(TELEMETRY, SETTLED, ATTEMPTS, body="""
SELECT * FROM per_session WHERE session_id IN (SELECT session_id FROM settled)"""))
def _(t):
    return sequence.confrontation_attempts(rollup.only(t.telemetry(), settled(t)))


# Two runs of the standing job, just after session boundaries of the feed.
FOLDS = (datetime(2024, 1, 10, 0, 2), datetime(2024, 1, 19, 0, 2))
NOW = datetime(2024, 1, 31)
DONE = "done AS (" + " UNION ".join(f"""
  SELECT session_id FROM telemetry WHERE received_us < epoch_us(TIMESTAMP '{at}') GROUP BY ALL
  HAVING max(received_us) < epoch_us(TIMESTAMP '{at}') - 600000000""" for at in FOLDS) + ")"
_folded: dict[tuple, tuple[Versions, EventLog]] = {}


def folded_store(t) -> tuple[Versions, EventLog]:
    """The rollup after both folds, and the event log; written once for each session and state of the table.

    The log holds three batches: what came before the first fold, between both, and after the last.
    """
    key = (t.spark.sparkContext.applicationId, t.folder, t.stamp("events"))
    if key not in _folded:
        store = Versions(t.spark, scratch_path(t.spark, "rollup"))
        log = EventLog(t.spark, scratch_path(t.spark, "events"))
        # numbering the sessions is the costly part; once for all three batches
        events, came = stored(t.telemetry().select("event_id", *rollup.NEEDED), "feed"), F.col("received_at")
        log.append(events.filter(came < F.lit(FOLDS[0])))
        rollup.fold_changes(store, log, F.lit(FOLDS[0]))
        log.append(events.filter((came >= F.lit(FOLDS[0])) & (came < F.lit(FOLDS[1]))))
        rollup.fold_changes(store, log, F.lit(FOLDS[1]))
        log.append(events.filter(came >= F.lit(FOLDS[1])))
        _folded[key] = store, log
    return _folded[key]


@query("hybrid_after_failure", sql(TELEMETRY, NEXT, AFTER, body=" SELECT * FROM after_failure"))
def _(t):
    return rollup.friction_read_changes(*folded_store(t))[0]


@query("hybrid_attempts_to_pass", sql(TELEMETRY, ATTEMPTS, TO_PASS, body=" SELECT * FROM to_pass"))
def _(t):
    return rollup.friction_read_changes(*folded_store(t))[1]


@query("pending_sessions", sql(TELEMETRY, DONE, body="""
SELECT session_id, count(*) AS events, min(seq) AS first, max(seq) AS last FROM telemetry
WHERE session_id NOT IN (SELECT session_id FROM done) GROUP BY session_id"""))
def _(t):
    # what the next fold and every hybrid read open
    return rollup.pending(*folded_store(t))[0].groupBy("session_id").agg(
        F.count("*").alias("events"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("rollup_equals_recompute", sql(TELEMETRY, body="""
SELECT count(*) AS rows, 0 AS only_in_one FROM (
  SELECT DISTINCT session_id, suspect, topic FROM telemetry
  WHERE type = 'ConfrontationAttempted')"""))
def _(t):
    # symmetric difference of what the folds wrote, with the live rest, and a full recompute
    (store, _), events = folded_store(t), t.telemetry()
    live = rollup.only(events, rollup.unfolded(events, store.read_all("sessions_done")))
    union = sequence.confrontation_attempts(live).unionByName(
        store.read_all("attempts").drop("version"))
    full = sequence.confrontation_attempts(events)
    differing = rollup.difference(union, full).agg(F.count("*").cast("int").alias("only_in_one"))
    return full.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(differing))


@query("fold_log", sql(TELEMETRY, DONE, body="""
SELECT (SELECT count(*) FROM done) AS sessions_folded, 2 AS runs"""))
def _(t):
    return folded_store(t)[0].commits().agg(F.sum("sessions_folded").alias("sessions_folded"),
                                         F.count("*").cast("int").alias("runs"))


@query("rebuilt_rollup", sql(TELEMETRY, NEXT, body=f"""
, at_end AS (
  SELECT session_id FROM telemetry WHERE received_us < epoch_us(TIMESTAMP '{FOLDS[-1]}') GROUP BY ALL
  HAVING max(received_us) < epoch_us(TIMESTAMP '{FOLDS[-1]}') - 600000000)
SELECT env, mod_id, suspect, topic, next_action, count(*) AS count
FROM fails WHERE session_id IN (SELECT session_id FROM at_end) GROUP BY ALL"""))
def _(t):
    at = F.lit(FOLDS[-1])
    store = rollup.rebuild(t.spark, scratch_path(t.spark, "rebuilt"),
                           t.telemetry().filter(F.col("received_at") < at), at)
    return store.read_all("friction").select(*rollup.GRAIN, *sequence.PARTIAL_KEYS, "count")


@query("live_coverage", sql(TELEMETRY, DONE, body=f"""
SELECT epoch(TIMESTAMP '{NOW}') - epoch(TIMESTAMP '{FOLDS[-1]}') AS fold_stale_seconds,
  count(DISTINCT session_id) AS live_sessions,
  count(DISTINCT session_id) FILTER (WHERE received_us > epoch_us(TIMESTAMP '{NOW}') - 86400000000)
    AS in_window
FROM telemetry WHERE session_id NOT IN (SELECT session_id FROM done)"""))
def _(t):
    store, log = folded_store(t)
    recent = rollup.unfolded(rollup.pending(store, log)[0], None, F.lit(NOW), timedelta(days=1)).agg(
        F.count("*").alias("in_window"))
    state = rollup.coverage_changes(store, log, F.lit(NOW))
    return state.select(F.col("fold_stale_seconds").cast("double").alias("fold_stale_seconds"),
                        "live_sessions").crossJoin(F.broadcast(recent))


@query("late_after_fold", sql(TELEMETRY, body=""",
early AS (
  SELECT session_id FROM telemetry WHERE received_us < epoch_us(TIMESTAMP '2024-01-17 12:00:00')
  GROUP BY ALL HAVING max(received_us) < epoch_us(TIMESTAMP '2024-01-17 12:00:00') - 600000000)
SELECT session_id, seq, type FROM telemetry JOIN early USING (session_id)
WHERE received_us >= epoch_us(TIMESTAMP '2024-01-17 12:00:00')"""))
def _(t):
    # a fold in the middle of the month, seen from its end
    at = F.lit(datetime(2024, 1, 17, 12))
    events = t.telemetry()
    done = rollup.settled(events.filter(F.col("received_at") < at), at).withColumn("rolled_at", at)
    return rollup.late_after_fold(events, done).select("session_id", "seq", "type")
