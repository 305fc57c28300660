"""Fold invariants: nothing is counted twice or lost, whatever the order of folds."""

import pathlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulse.operators import sequence
from pulse.plans import rollup
from pulse.plans.versions import Versions


@pytest.fixture(scope="module")
def events(tables):
    columns = ["session_id", "install_id", "seq", "block", "type", "env", "mod_id", "suspect",
               "topic", "passed", "completed", "ts", "received_at"]
    return tables.telemetry().select(*columns).cache()


def full(events):
    return (sequence.after_failure(sequence.after_failure_partials(events)),
            sequence.attempts_to_pass(sequence.confrontation_attempts(events)))


def equal(a, b):
    return rollup.difference(a, b).isEmpty()


def at(day, hour=0):
    """Just after a session boundary of the feed (every third day). Folding inside a session is
    the late-data case and has its own test."""
    return F.lit(datetime(2024, 1, day, hour, 2))


def arrived(events, day):
    return events.filter(F.col("received_at") < at(day))


def test_fold_plus_live_equals_recompute_at_every_step(spark, events, scratch):
    store = Versions(spark, scratch("fold"))
    folded = 0
    for day in (7, 10, 19):
        seen = arrived(events, day)
        folded += rollup.fold(store, seen, at(day))
        for got, want in zip(rollup.friction_read(store, seen), full(seen)):
            assert equal(got, want)
    assert folded == store.read_all("sessions_done").count() > 0
    # a second run right after finds nothing, changes nothing, and still reports itself alive
    before = store.read_all("friction").drop("version").groupBy().sum("count").first()[0]
    assert rollup.fold(store, arrived(events, 19), at(19)) == 0
    assert store.read_all("friction").groupBy().sum("count").first()[0] == before
    state = rollup.coverage(store, arrived(events, 19), at(19, 1)).first()
    assert state.fold_stale_seconds == 3600 and state.live_sessions > 0

    # incremental equals rebuilt, and many folds equal one
    rebuilt = rollup.rebuild(spark, scratch("rebuild"), arrived(events, 19), at(19))
    compacted = rollup.compact(store, scratch("compact"))
    grain = [*rollup.GRAIN, *sequence.PARTIAL_KEYS]
    sums = [F.sum(c).alias(c) for c in ("count", "gap_count", "sum_gap_us")]
    a, b, c = (s.read_all("friction").groupBy(*grain).agg(*sums)
               for s in (store, rebuilt, compacted))
    assert equal(a, b) and equal(a, c)
    assert compacted.latest() == 1
    assert equal(*(s.read_all("attempts").drop("version") for s in (store, rebuilt)))


def test_uncommitted_fold_is_invisible_and_replaced(spark, events, scratch):
    store = Versions(spark, scratch("crash"))
    rollup.fold(store, arrived(events, 7), at(7))
    before = store.read_all("friction").count()
    # a run that died before its commit
    store.read("friction", 1).write.parquet(store._path("friction", 2))
    store.read("sessions_done", 1).limit(1).write.parquet(store._path("sessions_done", 2))
    assert store.read_all("friction").count() == before and store.latest() == 1
    seen = arrived(events, 16)
    rollup.fold(store, seen, at(16))
    assert equal(rollup.friction_read(store, seen)[0], full(seen)[0])


def test_read_before_any_fold(spark, events, scratch):
    store = Versions(spark, scratch("none"))
    for got, want in zip(rollup.friction_read(store, events), full(events)):
        assert equal(got, want)
    assert rollup.coverage(store, events, at(31)).first().fold_stale_seconds is None


def test_late_events_are_stored_but_not_folded(spark, events, scratch):
    store = Versions(spark, scratch("late"))
    rollup.fold(store, arrived(events, 8), at(8))
    late = rollup.late_after_fold(events, store.read_all("sessions_done"))
    ids = late.select("session_id").distinct()
    done = store.read_all("sessions_done")
    assert ids.join(done, "session_id", "left_anti").isEmpty()
    again = rollup.settled(events, at(31), done)
    assert again.join(ids, "session_id", "left_semi").isEmpty()


def test_shuffled_and_repeated_input_changes_nothing(events):
    from pulse.sources.ingest import first_delivery
    noisy = first_delivery(events.unionByName(events).orderBy(F.rand(5)))
    assert equal(full(noisy)[0], full(events)[0]) and equal(full(noisy)[1], full(events)[1])


def test_a_damaged_commit_is_an_error_and_not_an_empty_store(spark, scratch):
    base = scratch("damaged")
    store = Versions(spark, base)
    assert store.latest() is None
    store.write({"rows": spark.range(3)})
    store.write({"rows": spark.range(5)})
    part = next(p for p in pathlib.Path(base, "commits", "version=2").iterdir() if p.name.startswith("part-"))
    part.write_bytes(b"no longer a table")
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        store.latest()
    with pytest.raises(Exception):
        store.write({"rows": spark.range(9)})
    assert spark.read.parquet(f"{base}/rows/version=1").count() == 3


def test_a_slow_batch_is_reported_late(spark, scratch):
    columns = "session_id string, install_id string, seq long, block long, type string, env string, mod_id string, suspect string, " \
        "topic string, passed boolean, completed boolean, ts timestamp, received_at timestamp"

    def event(seq, minute, passed):
        at = datetime(2024, 1, 1, 11, minute)
        return ("s", "i", seq, 0, "ConfrontationAttempted", "prod", "m", "a", "t", passed, None, at, at)
    seen = spark.createDataFrame([event(0, 10, False), event(1, 20, False)], columns)
    store = Versions(spark, scratch("slow"))
    assert rollup.fold(store, seen, F.lit(datetime(2024, 1, 1, 12))) == 1
    # stamped before the fold, visible only after it
    now = seen.unionByName(spark.createDataFrame([event(2, 40, True)], columns))
    done = store.read_all("sessions_done")
    assert [r.seq for r in rollup.late_after_fold(now, done).collect()] == [2]
    # one stamped even before the newest folded arrival shows in the count
    odd = seen.unionByName(spark.createDataFrame([event(3, 15, True)], columns))
    assert [tuple(r) for r in rollup.changed_sessions(odd, done).collect()] == [("s", 2, 3)]
    assert rollup.changed_sessions(seen, done).isEmpty()
