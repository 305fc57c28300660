"""Streaming ingest and the stateful fold agree with their batch forms."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulse.functions import verdicts
from pulse.operators import sequence
from pulse.plans import rollup
from pulse.plans.versions import Versions
from pulse.streaming import ingest as stream
from pulse.streaming import settle as settling

ID = "00000000-0000-4000-8000-00000000000"


def event(seq, session=1, **fields):
    body = {"v": 1, "type": "AreaEntered", "seq": seq, "install_id": ID + "9",
            "session_id": f"{ID}{session}", "ts": 1_700_000_000_000 + seq, "data": {}, **fields}
    return f"[12:00:00.000 I] Global[x]: OMWA1 {json.dumps(body)}\n"


def write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(lines))


def run(spark, logs, base):
    stream.start_ingest(stream.read_log_stream(spark, str(logs)), base, "dev",
                        every=None).awaitTermination()
    return stream.read_events(spark, base)


def test_ingest_is_exactly_once(spark, tmp_path):
    logs, base = tmp_path / "logs", str(tmp_path / "out")
    write(logs, "a.log", "noise\n", event(0), event(1), "x OMWA1 {broken\n", event(1))
    assert run(spark, logs, base).count() == 2
    # a rotated log repeats old lines and brings new ones
    write(logs, "b.log", event(1), event(2), event(0, session=2), event(-1))
    events = run(spark, logs, base)
    assert {(r.session_id[-1], r.seq) for r in events.collect()} == {
        ("1", 0), ("1", 1), ("1", 2), ("2", 0)}
    assert {r.env for r in events.collect()} == {"dev"}
    bad = spark.read.json(f"{base}/quarantine")
    assert sorted(v for r in bad.collect() for v in r.violations) == ["payload", "seq"]


def test_running_again_adds_nothing(spark, tmp_path):
    logs, base = tmp_path / "logs", str(tmp_path / "out")
    write(logs, "a.log", event(0))
    before = run(spark, logs, base).count()
    lines = spark.read.text(str(logs)).withColumnRenamed("value", "line")
    stream.append_batch(lines, 0, base, "dev")  # as after a lost driver
    assert stream.read_events(spark, base).count() == before == 1


def test_drop_repeats(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.range(4).select(F.lit("s").alias("session_id"), (F.col("id") % 2).alias("seq"),
                                 F.current_timestamp().alias("received_at"))
    rows.write.parquet(folder)
    q = (stream.drop_repeats(spark.readStream.schema(rows.schema).parquet(folder)).writeStream
         .format("memory").queryName("kept").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination()
    assert spark.table("kept").count() == 2


def test_settled_sessions_match_batch(spark, tables, tmp_path):
    """Events in shuffled files, twice; the emitted sessions equal the batch fold."""
    folder = tmp_path / "in"
    columns = ["session_id", "install_id", "seq", "type", "suspect", "topic", "passed",
               "completed", "ts", "received_at"]
    events = tables.telemetry().select(*columns)
    # one file per two days: sessions span files, rows inside a file are unordered and doubled
    day = F.floor(F.datediff("received_at", F.lit("2024-01-01")) / 2)
    doubled = events.unionByName(events).withColumn("part", day)
    for n in range(16):
        (doubled.filter(F.col("part") == n).drop("part").orderBy(F.xxhash64("seq", "session_id"))
         .coalesce(1).write.mode("append").parquet(str(folder)))
    q = (settling.settle(spark.readStream.schema(events.schema)
                         .option("maxFilesPerTrigger", 1).parquet(str(folder)))
         .writeStream.format("memory").queryName("settled").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.table("settled")
    done = out.filter("kind <> 'late'").select("session_id").distinct()
    assert done.count() > 100
    assert out.filter("kind = 'late'").isEmpty()
    whole = tables.telemetry().join(done, "session_id", "left_semi")
    want = sequence.after_failure_partials(whole)
    got = (out.filter("kind = 'after_failure'").groupBy("suspect", "topic", "next_action")
           .agg(*[F.sum(c).alias(c) for c in ("count", "gap_count", "sum_gap_us")]))
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    names = ["session_id", "install_id", "suspect", "topic", "total_attempts", "attempts_to_pass"]
    tries = out.filter("kind = 'attempts'").select(*names)
    assert sequence.confrontation_attempts(whole).select(*names).exceptAll(tries).isEmpty()


def test_the_settling_stream_fills_the_rollup_through_a_crash(spark, tables, tmp_path, scratch, monkeypatch):
    """The job dies twice, before and after a commit; the rollup equals the batch fold of its sessions."""
    folder = tmp_path / "in"
    events = tables.telemetry().select(*rollup.NEEDED).cache()
    day = F.floor(F.datediff("received_at", F.lit("2024-01-01")) / 4)
    for n in range(8):
        events.filter(day == n).orderBy(F.xxhash64("seq")).coalesce(1).write.mode("append").parquet(str(folder))
    store = Versions(spark, scratch("settled"))
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    def run():
        settling.start_settle(feed, store, str(tmp_path / "ck")).awaitTermination()
    commit, calls = Versions.commit, []

    def dying(self, *args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("before the commit")
        commit(self, *args)
        if len(calls) == 4:
            raise RuntimeError("after the commit")
    monkeypatch.setattr(Versions, "commit", dying)
    for _ in range(2):
        with pytest.raises(Exception, match="commit"):
            run()
    run()
    done = store.read_all("sessions_done")
    assert done.count() == done.select("session_id").distinct().count() > 100
    assert store.read_all("late").isEmpty()
    whole = events.join(done.select("session_id"), "session_id", "left_semi")
    grain = [*rollup.GRAIN, *sequence.PARTIAL_KEYS]
    got = store.read_all("friction").groupBy(*grain).agg(*[F.sum(c).alias(c) for c in ("count", "gap_count", "sum_gap_us")])
    assert rollup.difference(got, sequence.after_failure_partials(whole, *rollup.GRAIN)).isEmpty()
    assert rollup.difference(store.read_all("attempts").drop("version"), sequence.confrontation_attempts(whole)).isEmpty()
    counted = whole.groupBy("session_id").agg(F.count("*").alias("n"), F.max("received_at").alias("at"))
    assert done.join(counted, "session_id").filter((F.col("events") != F.col("n")) | (F.unix_millis("last_at") != F.unix_millis("at"))).isEmpty()
    # with the sessions still open, the hybrid read is the whole
    both = rollup.friction_read(store, events)
    assert rollup.difference(both[0], sequence.after_failure(sequence.after_failure_partials(events))).isEmpty()


def test_late_events_are_reported(spark, tmp_path):
    schema = ("session_id string, install_id string, seq long, type string, suspect string, "
              "topic string, passed boolean, completed boolean, ts timestamp, "
              "received_at timestamp")

    def rows(*items):
        frame = spark.createDataFrame(
            [(s, "i", n, "AreaEntered", None, None, None, None, at, at) for s, n, at in items],
            "a string, b string, c long, d string, e string, f string, g boolean, h boolean, "
            "i string, j string").toDF(*[c.split()[0] for c in schema.split(", ")])
        frame.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "received_at")}).coalesce(
            1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        q = (settling.settle(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
             .writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
             .start())
        q.awaitTermination()

    rows(("old", 0, "2024-01-01 10:00:00"))
    drain()
    rows(("new", 0, "2024-01-01 12:00:00"))
    drain()
    rows(("new", 1, "2024-01-01 12:01:00"))
    drain()
    # within the watermark on arrival, but its session was emitted an hour ago
    rows(("old", 1, "2024-01-01 12:02:00"))
    drain()
    late = spark.read.parquet(str(tmp_path / "out")).filter("kind = 'late'").collect()
    assert [(r.session_id, r.seq) for r in late] == [("old", 1)]


def test_the_last_session_settles_when_traffic_stops(spark, tmp_path):
    columns = ("session_id string, install_id string, seq long, type string, suspect string, topic string, "
               "passed boolean, completed boolean, ts timestamp, received_at timestamp")
    at = datetime(2024, 1, 1, 10)
    rows = [("s", "i", n, "ConfrontationAttempted", "a", "t", n == 1, None, at, at) for n in range(2)]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
    q = (settling.settle(events, idle=timedelta(seconds=2), forget=timedelta(seconds=2))
         .writeStream.format("memory").queryName("idle").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start())
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("idle").count() == 3:
                break
        got = {r.kind: r for r in spark.table("idle").collect()}
        assert got["attempts"].attempts_to_pass == 2 and got["after_failure"].next_action == "retried_same"
        for _ in range(120):  # and its state goes
            time.sleep(0.5)
            if q.lastProgress and sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) == 0:
                break
        assert sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) == 0
    finally:
        q.stop()


def test_the_standing_fold_runs_on_its_cadence(spark, tables, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    events = tables.telemetry().filter(F.col("received_at") < F.lit(datetime(2024, 1, 10, 0, 2)))
    pings = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    q = stream.start_fold(pings, store, lambda: events, lambda: F.lit(datetime(2024, 1, 10, 0, 2)),
                             str(tmp_path / "ck"), every="1 second")
    try:
        for _ in range(240):
            time.sleep(0.5)
            if (store.latest() or 0) >= 2:
                break
    finally:
        q.stop()
    runs = store.commits().orderBy("version").collect()
    assert len(runs) >= 2 and runs[0].sessions_folded > 0 and runs[1].sessions_folded == 0


def test_the_two_ladders_agree(spark):
    kinds = ["ConfrontationAttempted", "ConfrontationExited", "AreaEntered", "Other"]
    rows = [(a, b, k, c, d, e) for a in ("x", None) for b in ("t", None) for k in kinds
            for c in ("x", "y", None) for d in ("t", None) for e in (True, False, None)]
    frame = spark.createDataFrame(rows, "suspect string, topic string, type string, s2 string, t2 string, completed boolean")
    nxt = F.struct("type", F.col("s2").alias("suspect"), F.col("t2").alias("topic"), "completed")
    got = frame.select("*", verdicts.next_action(F.col("suspect"), F.col("topic"), nxt).alias("action")).collect()
    for r in got:
        event = {"type": r.type, "suspect": r.s2, "topic": r.t2, "completed": r.completed}
        assert settling.bucket(r.suspect, r.topic, event) == r.action
