"""Block-wise windows give what one window over the whole key gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulse.operators import blocked
from pulse.operators.sequence import session_attempts


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 400), ("warm", 37), ("one", 1)):
        # some sequence numbers never arrived; whole blocks may be missing
        for seq in range(n):
            if rng.random() < 0.8 and not 100 <= seq < 130:
                rows.append((key, seq, rng.choice("abc"), rng.random() < 0.2,
                             rng.choice(["x", None, None])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, seq long, topic string, passed boolean, "
                                     "item string")
    return blocked.with_block(df.withColumn("install_id", F.col("session_id")), rows=10)


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_lead(events):
    w = Window.partitionBy("session_id").orderBy("seq")
    plain = events.withColumn("n", F.lead("seq").over(w)).select("session_id", "seq", "n")
    got = blocked.lead_struct(events, ["session_id"], "seq", ["seq"]).select(
        "session_id", "seq", F.col("nxt.seq").alias("n"))
    assert same(got, plain)


def test_number_rows(events):
    w = Window.partitionBy("session_id", "topic").orderBy("seq")
    plain = events.withColumn("n", F.row_number().over(w).cast("long"))
    got = blocked.number_rows(events, ["session_id", "topic"], [F.asc("seq")], "n")
    columns = ["session_id", "seq", F.col("n").cast("long")]
    assert same(got.select(*columns), plain.select(*columns))


@pytest.mark.parametrize("inclusive", [False, True])
def test_carry_last(events, inclusive):
    w = (Window.partitionBy("session_id").orderBy("seq")
         .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    plain = events.withColumn("last", F.last("item", ignorenulls=True).over(w))
    got = blocked.carry_last(events, ["session_id"], "seq", {"last": F.col("item")}, inclusive)
    assert same(got.select("session_id", "seq", "last"), plain.select("session_id", "seq", "last"))


def test_session_attempts(events):
    w = Window.partitionBy("session_id", "topic").orderBy("seq")
    plain = (events.withColumn("no", F.row_number().over(w)).groupBy("session_id", "topic")
             .agg(F.count("*").alias("total_attempts"),
                  F.min(F.when(F.col("passed"), F.col("no"))).cast("long")
                  .alias("attempts_to_pass")))
    got = session_attempts(events, ("topic",)).select(
        "session_id", "topic", "total_attempts", F.col("attempts_to_pass").cast("long"))
    assert same(got, plain)


def test_hot_sessions_change_nothing(tables):
    """The feed cut into minute blocks for every session numbers rows as the uncut one does."""
    cut, plain = tables.telemetry(hot_rows=1), tables.telemetry()
    assert cut.filter("block > 0").count() > 0 and plain.filter("block > 0").isEmpty()
    assert same(cut.select("event_id", "seq"), plain.select("event_id", "seq"))


def test_after_failure_with_hot_sessions(tables):
    from pulse.operators import sequence
    a = sequence.after_failure_partials(tables.telemetry(hot_rows=1))
    b = sequence.after_failure_partials(tables.telemetry())
    assert same(a, b)
