"""Quantiles by ranges and pages by days, against plain definitions."""

import math
import pathlib
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_eventlog import SCHEMA

from pulse.operators import explorer, stats
from pulse.plans.eventlog import EventLog

SHARES = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "all": 1.0}


def disc(values, share):
    """The smallest value that at least this share of all does not exceed."""
    ordered = sorted(values)
    return ordered[max(0, math.ceil(len(ordered) * share - 1e-12) - 1)]


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "j"]])
def test_quantiles_against_the_definition(spark, keys):
    rnd = random.Random(len(keys))
    rows = [(None if rnd.random() < 0.1 else "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}", rnd.randrange(2),
             rnd.choice([rnd.randrange(10), rnd.randrange(100_000)])) for _ in range(5000)]
    frame = spark.createDataFrame(rows, "k string, j int, v long")
    want = {}
    for row in rows:
        want.setdefault(row[:len(keys)], []).append(row[2])
    got = {tuple(r[k] for k in keys): r for r in stats.quantiles_disc(frame, keys, "v", SHARES).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        r = got[key]
        assert (r.n, r.max) == (len(values), max(values))
        assert [r[name] for name in SHARES] == [disc(values, share) for share in SHARES.values()]


def test_quantiles_of_nothing(spark):
    assert stats.quantiles_disc(spark.createDataFrame([], "k string, v long"), ["k"], "v", SHARES).collect() == []


def test_no_window_spans_all_values(spark):
    frame = spark.range(5000).select(F.col("id").alias("v"))
    plan = stats.quantiles_disc(frame, [], "v", SHARES)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    # the histogram's own window is cut by range; those without a cut see one row per range
    assert any("_range#" in line and "sum(_n" in line for line in windows)
    assert all("sum(_rows" in line for line in windows if "sum(_n" not in line)


def test_pages_of_a_log(spark, scratch):
    rnd = random.Random(2)
    base, start = scratch("pages"), datetime(2024, 1, 1)
    log, rows = EventLog(spark, base), []
    for batch in range(3):
        new = []
        for n in range(batch * 300, batch * 300 + 300):
            ts = start + timedelta(days=rnd.choice([0, 1, 1, 2, 5, 9]) + batch, seconds=rnd.randrange(50))
            new.append((f"s{n % 7}", "i", n, 0, rnd.choice(["AreaEntered", "Other"]), "prod", "m", None, None, None, None, ts, ts))
        log.append(spark.createDataFrame(new, SCHEMA))
        rows += new
    assert sum(n for _, n in log.days()) == len(rows) and log.days() == sorted(log.days(), reverse=True)
    for filters in ({}, {"type": "Other"}, {"type": "none of these"}):
        want = sorted(((r[11], r[0], r[2]) for r in rows if not filters or r[4] == filters["type"]), reverse=True)
        cursor, got = None, []
        while True:
            fetched = [r for r in explorer.newest_page(log, filters, cursor, 100).withColumn("ts_us", F.unix_micros("ts")).collect()]
            got += fetched[:100]
            cursor = explorer.next_cursor(fetched, 100)
            if cursor is None:
                break
        assert [(r.ts, r.session_id, r.seq) for r in got] == want
    # the first page opens the newest days only: without the others it is the same
    first = explorer.newest_page(log, size=20).collect()
    keep = {f"event_date={day}" for day, _ in log.days()[:2]}
    for folder in pathlib.Path(base, "events").glob("batch=*/event_date=*"):
        if folder.name not in keep:
            shutil.rmtree(folder)
    assert explorer.newest_page(log, size=20).collect() == first
    assert explorer.newest_page(EventLog(spark, scratch("none"))) is None
