"""Incremental friction rollup: fold settled sessions once, read folded and live halves together.

Each fold is one version of `friction`, `attempts` and `sessions_done` in a `Versions` store, all
computed from one written set of settled sessions. The commit record is written last and doubles as
the fold's liveness entry, so a quiet run still shows a recent time.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.operators import sequence
from pulse.plans.eventlog import EventLog, Spans, without
from pulse.plans.versions import Versions
from pulse.session import discard, scratch_path

LATENESS = timedelta(minutes=10)
# The rollup keeps these, so a read can still be scoped to an environment or a mod.
GRAIN = ("env", "mod_id")


def settled(events: DataFrame, as_of: Column, done: DataFrame | None = None,
            lateness: timedelta = LATENESS) -> DataFrame:
    """(session_id, last_at, events) of sessions whose newest delivery is older than `lateness`
    (arrival time, not event time)."""
    idle = (events.groupBy("session_id").agg(F.max("received_at").alias("last_at"),
                                             F.count(F.lit(1)).alias("events"))
            .filter(F.col("last_at") < as_of - F.lit(lateness)))
    return idle if done is None else idle.join(done.select("session_id"), "session_id",
                                               "left_anti")


def unfolded(events: DataFrame, done: DataFrame | None, as_of: Column | None = None,
             window: timedelta | None = None) -> DataFrame:
    """Sessions in no fold yet, optionally only those heard from within `window`.

    Split on what was folded, not on the watermark: a session that has settled but is not folded
    would otherwise be in neither half.
    """
    rows = events if window is None else events.filter(
        F.col("received_at") > as_of - F.lit(window))
    sessions = rows.select("session_id").distinct()
    return sessions if done is None else sessions.join(done.select("session_id"), "session_id",
                                                       "left_anti")


def only(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Whole sessions, so no other session's sequence changes."""
    return events.join(sessions.select("session_id"), "session_id", "left_semi")


def fold(store: Versions, events: DataFrame, as_of: Column,
         lateness: timedelta = LATENESS) -> int:
    """Fold every settled session not folded yet; returns how many."""
    done = store.read_all("sessions_done")
    version = (store.latest() or 0) + 1
    # written before it is used, so all three outputs come from the same set whatever arrives
    store.write_uncommitted("sessions_done", version,
                            settled(events, as_of, done, lateness).withColumn("rolled_at", as_of))
    sessions = store.read("sessions_done", version)
    folded = sessions.count()
    rows = only(events, sessions)
    store.write_uncommitted("friction", version, sequence.after_failure_partials(rows, *GRAIN))
    store.write_uncommitted("attempts", version, sequence.confrontation_attempts(rows))
    store.commit(version, store.spark.range(1).select(
        as_of.alias("last_run_at"), F.lit(folded).cast("long").alias("sessions_folded")))
    return folded


def friction_read(store: Versions, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(after_failure, attempts_to_pass) over all sessions, folded or not."""
    live = only(events, unfolded(events, store.read_all("sessions_done")))
    return _with_folded(store, sequence.after_failure_partials(live, *GRAIN), sequence.confrontation_attempts(live))


def _with_folded(store: Versions, partials: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    folded = store.read_all("friction")
    if folded is not None:
        partials = partials.unionByName(folded.drop("version"))
        attempts = attempts.unionByName(store.read_all("attempts").drop("version"))
    return sequence.after_failure(partials), sequence.attempts_to_pass(attempts)


# ---- by change: what no fold has taken, instead of all events ever stored ----------------------------

# What the sequences read; a session left open is kept with these.
NEEDED = ("session_id", "install_id", "seq", "block", "type", "env", "mod_id", "suspect", "topic", "passed", "completed",
          "ts", "received_at")


def folded_batches(store: Versions) -> Spans:
    """Batches that some fold has read."""
    version = store.latest()
    if version is None:
        return []
    return [tuple(s) for s in store.commits().filter(F.col("version") == version).first()["batches"]]


def pending(store: Versions, log: EventLog) -> tuple[DataFrame | None, Spans]:
    """(events of sessions in no fold, all committed batches).

    These are the sessions that the last fold left open, which it kept, and what came in batches it did
    not see, whatever their number: a slow batch that was committed after later ones is still read.
    Late events of a folded session are left out.
    """
    batches, version = log.batches(), store.latest()
    rows = log.read(without(batches, folded_batches(store)))
    rows = rows if rows is None else _needed(rows)
    if version is not None:
        rows = rows.join(store.read_all("sessions_done").select("session_id"), "session_id", "left_anti").select(*rows.columns)
        rows = rows.unionByName(store.read("open_events", version))
    return rows, batches


def _needed(rows: DataFrame) -> DataFrame:
    missing = [c for c in NEEDED if c not in rows.columns]  # a column that the log does not keep is null
    return rows.select(*NEEDED) if not missing else rows.withColumns(
        {c: F.lit(None).cast("boolean") for c in missing}).select(*NEEDED)


def fold_changes(store: Versions, log: EventLog, as_of: Column, lateness: timedelta = LATENESS) -> int:
    """`fold` of what is pending; the sessions that stay open are written for the next one."""
    rows, batches = pending(store, log)
    version = (store.latest() or 0) + 1
    folded = 0
    if rows is not None:
        store.write_uncommitted("sessions_done", version, settled(rows, as_of, None, lateness).withColumn("rolled_at", as_of))
        sessions = store.read("sessions_done", version)
        folded = sessions.count()
        taken = only(rows, sessions)
        store.write_uncommitted("friction", version, sequence.after_failure_partials(taken, *GRAIN))
        store.write_uncommitted("attempts", version, sequence.confrontation_attempts(taken))
        store.write_uncommitted("open_events", version, rows.join(sessions.select("session_id"), "session_id", "left_anti").select(*NEEDED))
        covers = F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for a, b in batches])
        store.commit(version, store.spark.range(1).select(
            as_of.alias("last_run_at"), F.lit(folded).cast("long").alias("sessions_folded"), covers.alias("batches")))
    return folded


def friction_read_changes(store: Versions, log: EventLog) -> tuple[DataFrame, DataFrame]:
    """`friction_read` that opens only what is pending."""
    live, _ = pending(store, log)
    if live is None:
        live = store.spark.createDataFrame([], _EMPTY)
    return _with_folded(store, sequence.after_failure_partials(live, *GRAIN), sequence.confrontation_attempts(live))


def coverage_changes(store: Versions, log: EventLog, as_of: Column) -> DataFrame:
    """`coverage` that opens only what is pending."""
    live, _ = pending(store, log)
    return coverage(store, store.spark.createDataFrame([], _EMPTY) if live is None else live, as_of)


_EMPTY = ("session_id string, install_id string, seq long, block long, type string, env string, mod_id string, suspect string, "
          "topic string, passed boolean, completed boolean, ts timestamp, received_at timestamp")


def coverage(store: Versions, events: DataFrame, as_of: Column) -> DataFrame:
    """Seconds since the fold last ran (null = never) and the number of live sessions."""
    live = unfolded(events, store.read_all("sessions_done")).agg(
        F.count("*").alias("live_sessions"))
    commits = store.commits()
    stale = (F.lit(None).cast("long") if commits is None else
             (as_of.cast("double") - F.max("last_run_at").cast("double")).cast("long"))
    base = store.spark.range(1) if commits is None else commits
    return base.agg(stale.alias("fold_stale_seconds") if commits is not None
                    else F.max(stale).alias("fold_stale_seconds")).crossJoin(F.broadcast(live))


def commit_settled(store: Versions, rows: DataFrame, source: str | None, batch: int) -> None:
    """One micro-batch of `streaming.settle` as a version of the rollup, once whatever is run again."""
    # written before all else: the state of the stream advances by it, once, also when the batch is known
    scratch = scratch_path(store.spark, "settled")
    rows.write.parquet(scratch)
    rows, commits = store.spark.read.schema(rows.schema).parquet(scratch), store.commits()
    known = commits is not None and not commits.filter((F.col("source") == source) & (F.col("source_batch") == batch)).isEmpty()
    if not known and not rows.isEmpty():
        version = (store.latest() or 0) + 1
        sessions = rows.filter("kind = 'session'").select(
            "session_id", F.timestamp_millis("last_ms").alias("last_at"), "events", F.current_timestamp().alias("rolled_at"))
        store.write_uncommitted("sessions_done", version, sessions)
        store.write_uncommitted("friction", version, rows.filter("kind = 'after_failure'").groupBy(*GRAIN, *sequence.PARTIAL_KEYS).agg(
            *[F.sum(c).alias(c) for c in ("count", "gap_count", "sum_gap_us")]))
        store.write_uncommitted("attempts", version, rows.filter("kind = 'attempts'").select(
            "session_id", "suspect", "topic", "install_id", "total_attempts", "attempts_to_pass"))
        store.write_uncommitted("late", version, rows.filter("kind = 'late'").select("session_id", "seq"))
        store.commit(version, store.spark.range(1).select(
            F.current_timestamp().alias("last_run_at"), F.lit(sessions.count()).cast("long").alias("sessions_folded"),
            F.lit(source).cast("string").alias("source"), F.lit(batch).cast("long").alias("source_batch")))
    discard(store.spark, scratch)


def late_after_fold(events: DataFrame, done: DataFrame) -> DataFrame:
    """Events newer than what their session's fold saw: stored, but never in the rollup.

    Compared with the newest arrival that was folded, not with the time of the fold: a batch that
    was stamped before a fold and became visible after it is late as well.
    """
    return events.join(done.select("session_id", "last_at"), "session_id").filter(
        F.col("received_at") > F.col("last_at")).drop("last_at")


def changed_sessions(events: DataFrame, done: DataFrame) -> DataFrame:
    """(session_id, folded, now) of folded sessions that hold another number of events by now,
    whatever arrival time the new ones carry."""
    now = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("now"))
    return (now.join(done.select("session_id", F.col("events").alias("folded")), "session_id")
            .filter("now <> folded").select("session_id", "folded", "now"))


def rebuild(spark: SparkSession, base: str, events: DataFrame, as_of: Column) -> Versions:
    """The rollup from the log alone, in a new folder; must equal the incremental one."""
    store = Versions(spark, base)
    fold(store, events, as_of)
    return store


def compact(store: Versions, base: str) -> Versions:
    """Many folds as one, in a new folder."""
    target = Versions(store.spark, base)
    partials = store.read_all("friction").groupBy(*GRAIN, *sequence.PARTIAL_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("count", "gap_count", "sum_gap_us")])
    commits = store.commits().agg(F.max("last_run_at").alias("last_run_at"),
                                  F.sum("sessions_folded").alias("sessions_folded"))
    target.write({"friction": partials, "attempts": store.read_all("attempts").drop("version"),
                  "sessions_done": store.read_all("sessions_done").drop("version")}, commits)
    return target


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in only one of two results; empty means equal, duplicates included."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("b")))
