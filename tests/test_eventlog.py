"""The event log by batches: keys as runs, exactly-once appends, and folds that follow the change."""

import pathlib
import random
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_rollup import at, equal, full

from pulse.plans import eventlog, rollup
from pulse.plans.eventlog import EventLog
from pulse.plans.versions import Versions

SCHEMA = ("session_id string, install_id string, seq long, block long, type string, env string, mod_id string, suspect string, "
          "topic string, passed boolean, completed boolean, ts timestamp, received_at timestamp")


def rows_of(spark, keys, minute=0):
    when = datetime(2024, 1, 1, 0, minute)
    return spark.createDataFrame([(s, "i", n, n // 4096, "AreaEntered", "prod", "m", None, None, None, None, when, when) for s, n in keys], SCHEMA)


def stored_keys(log):
    return sorted((r.session_id, r.seq) for r in log.read().collect())


def test_spans():
    assert eventlog.spans([3, 1, 2, 7, 7, 9]) == [(1, 3), (7, 7), (9, 9)]
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ({rnd.randrange(30) for _ in range(rnd.randrange(20))} for _ in range(2))
        left = eventlog.without(eventlog.spans(a), eventlog.spans(b))
        assert [n for low, high in left for n in range(low, high + 1)] == sorted(a - b)


def test_appends_store_each_event_once(spark, scratch):
    rnd, log, want = random.Random(4), EventLog(spark, scratch("log")), set()
    assert log.read() is None and log.batches() == []
    for n in range(6):
        keys = [(f"s{rnd.randrange(12)}", rnd.randrange(40)) for _ in range(120)] + [("endless", k) for k in range(n * 4000, n * 4000 + 4500)]
        counts = log.append(rows_of(spark, keys, n), "stream", n)
        assert counts == {"received": len(keys), "inserted": len(set(keys) - want), "duplicates": len(keys) - len(set(keys) - want)}
        want |= set(keys)
        assert stored_keys(log) == sorted(want)
        if n in (2, 4):
            log.compact()
            held = [(r.session_id, k) for r in log.keys().collect() for k in range(r.low, r.high + 1)]
            assert sorted(held) == sorted(want)  # each key in one run
    assert log.batches() == [(0, 5)]


def test_running_a_batch_again(spark, scratch):
    base = scratch("again")
    log = EventLog(spark, base)
    log.append(rows_of(spark, [("a", 0), ("a", 1)]), "stream", 0)
    first = log.append(rows_of(spark, [("a", 1), ("b", 0)]), "stream", 1)
    # committed: left as it is, also after its keys were merged
    log.compact()
    assert log.append(rows_of(spark, [("a", 1), ("b", 0)]), "stream", 1) == first
    assert stored_keys(log) == [("a", 0), ("a", 1), ("b", 0)]
    # died before its commit: invisible, then written over
    log.append(rows_of(spark, [("c", 0), ("c", 1)]), "stream", 2)
    shutil.rmtree(f"{base}/commits/batch=2")
    assert stored_keys(log) == [("a", 0), ("a", 1), ("b", 0)] and log.number("stream", 2) == 2
    log.append(rows_of(spark, [("c", 0)]), "stream", 2)
    assert stored_keys(log) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]
    # another stream's batch 0 is a batch of its own
    log.append(rows_of(spark, [("c", 0), ("d", 0)]), "other", 0)
    assert stored_keys(log)[-2:] == [("c", 0), ("d", 0)] and log.batches() == [(0, 3)]
    # nothing new, and nothing at all
    assert log.append(rows_of(spark, [("d", 0)]), "other", 1)["inserted"] == 0
    assert log.append(rows_of(spark, []), "other", 2) == {"received": 0, "inserted": 0, "duplicates": 0}
    assert len(stored_keys(log)) == 5


def test_a_batch_reads_its_own_buckets_only(spark, scratch):
    base = scratch("buckets")
    log = EventLog(spark, base)
    log.append(rows_of(spark, [(f"s{n}", k) for n in range(300) for k in range(3)]), "stream", 0)
    assert len(list(pathlib.Path(base, "keys", "batch=0").glob("bucket=*"))) > 50
    own = spark.createDataFrame([("s7",)], "session_id string").select(eventlog.bucket_of()).first()[0]
    fresh = log.new_rows(rows_of(spark, [("s7", 1), ("s7", 5)]))
    assert f"bucket#" in (plan := fresh._jdf.queryExecution().toString()) and f"= {own})" in plan.split("PartitionFilters")[-1][:300]
    # with every other bucket gone the answer is the same: they are not opened
    for folder in pathlib.Path(base, "keys", "batch=0").glob("bucket=*"):
        if folder.name != f"bucket={own}":
            shutil.rmtree(folder)
    assert [r.seq for r in log.new_rows(rows_of(spark, [("s7", 1), ("s7", 5)])).collect()] == [5]


@pytest.fixture(scope="module")
def events(tables):
    return tables.telemetry().select(*rollup.NEEDED).cache()


def by_day(events, day):
    """What arrived on a day that starts two minutes after midnight, as the folds of these tests do."""
    return events.filter((F.col("received_at") >= at(day)) & (F.col("received_at") < at(day + 1)))


def test_folds_and_reads_follow_the_change(spark, events, scratch):
    base = scratch("log")
    log, store = EventLog(spark, base), Versions(spark, scratch("fold"))
    log.append(events.filter(F.col("received_at") < at(7)))
    for day in (7, 8, 9):
        log.append(by_day(events, day))
    so_far = events.filter(F.col("received_at") < at(10))
    for got, want in zip(rollup.friction_read_changes(store, log), full(so_far)):
        assert equal(got, want)
    assert rollup.fold_changes(store, log, at(10)) > 0
    # what was folded is not opened any more: gone from the disk, the reads and the next fold are the same
    for folder in pathlib.Path(base, "events").glob("batch=*"):
        shutil.rmtree(folder)
    log.append(by_day(events, 10))
    log.append(by_day(events, 11))
    so_far = events.filter(F.col("received_at") < at(12))
    for got, want in zip(rollup.friction_read_changes(store, log), full(so_far)):
        assert equal(got, want)
    folded = rollup.fold_changes(store, log, at(13))
    reference = Versions(spark, scratch("reference"))
    rollup.fold(reference, so_far.filter(F.col("received_at") < at(10)), at(10))
    assert folded == rollup.fold(reference, so_far, at(13)) > 0
    for name in ("friction", "attempts"):
        assert equal(store.read_all(name).drop("version"), reference.read_all(name).drop("version"))
    # nothing new: nothing folded, and the run is on record
    assert rollup.fold_changes(store, log, at(13)) == 0 and store.latest() == 3
    state = rollup.coverage_changes(store, log, at(13)).first()
    assert state.fold_stale_seconds == 0 and state.live_sessions == so_far.select("session_id").distinct().count() - (
        store.read_all("sessions_done").count())


def test_a_slow_batch_is_still_counted(spark, events, scratch):
    """Batch 1 is committed after batch 2 was folded; its sessions are folded later, and read at once."""
    base = scratch("slow")
    log, store = EventLog(spark, base), Versions(spark, scratch("fold"))
    log.append(events.filter((F.col("received_at") < at(7)) & (F.hash("session_id") % 2 == 0)))
    log.append(events.filter((F.col("received_at") < at(7)) & (F.hash("session_id") % 2 != 0)))
    log.append(by_day(events, 7))
    aside = scratch("aside")
    shutil.move(f"{base}/commits/batch=1", aside)
    assert log.batches() == [(0, 0), (2, 2)]
    rollup.fold_changes(store, log, at(8))
    assert rollup.folded_batches(store) == [(0, 0), (2, 2)]
    shutil.move(aside, f"{base}/commits/batch=1")
    # sessions of both the slow and the folded batches were cut in two by it; all others are whole
    done = store.read_all("sessions_done")
    live, _ = rollup.pending(store, log)
    seen = events.filter(F.col("received_at") < at(8))
    assert live.join(done, "session_id", "left_semi").isEmpty()
    assert live.count() == seen.join(done, "session_id", "left_anti").count()
    assert rollup.fold_changes(store, log, at(8)) > 0 and rollup.folded_batches(store) == [(0, 2)]


def test_before_any_batch(spark, scratch):
    log, store = EventLog(spark, scratch("none")), Versions(spark, scratch("fold"))
    assert rollup.fold_changes(store, log, at(8)) == 0 and store.latest() is None
    assert rollup.friction_read_changes(store, log)[0].collect() == []
    assert rollup.coverage_changes(store, log, at(8)).first().live_sessions == 0
    log.compact()
    assert log.keys() is None
