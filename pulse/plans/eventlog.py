"""Stored events in numbered, committed batches, and the keys they hold.

Layout: `<base>/events/batch=N/event_date=D/`, `<base>/keys/batch=N/bucket=B/`, `<base>/commits/batch=N/`.
A batch is written under its number and committed last; one that died before is invisible, and running
it again writes over it. A stream's micro-batch keeps the number it was given, whatever is run again.

Folds and reads take what they need by number (`spans`), so they follow the change, not the history.

Keys are kept apart from the events as runs of sequence numbers, (session_id, part, low, high): sequences
are dense, so a session's hundreds of events are a row or two. A new batch reads only the buckets that its
own sessions fall into, and is matched on (session, part of the sequence), so an endless session is
spread. `compact` merges the runs of many batches.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulse.plans.versions import Versions, read_if_there
from pulse.session import discard, scratch_path
from pulse.sources import ingest

Spans = list[tuple[int, int]]
_COMMIT = "source string, source_batch long, received long, inserted long, days array<struct<day:date,rows:long>>"
BUCKETS = 64
PART = 4096  # sequence numbers of one part


def spans(numbers: Iterable[int]) -> Spans:
    """Runs [low, high] of numbers."""
    out: Spans = []
    for n in sorted(set(numbers)):
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def without(numbers: Spans, gone: Spans) -> Spans:
    """What is left of some runs when others are taken away."""
    out = []
    for low, high in numbers:
        for a, b in sorted(gone):
            if b < low or a > high:
                continue
            if a > low:
                out.append((low, a - 1))
            low = b + 1
        if low <= high:
            out.append((low, high))
    return out


def within(column: Column, numbers: Spans) -> Column:
    test = F.lit(False)
    for low, high in numbers:
        test = test | ((column == low) if low == high else column.between(low, high))
    return test


def bucket_of(session: str = "session_id") -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def _part() -> Column:
    return F.floor(F.col("seq") / PART).cast("long")


def runs(rows: DataFrame) -> DataFrame:
    """(bucket, session_id, part, low, high): runs of the sequence numbers in `rows`, for each part of a session."""
    keys = rows.select("session_id", "seq", _part().alias("part")).distinct()
    place = F.row_number().over(Window.partitionBy("session_id", "part").orderBy("seq"))
    return (keys.withColumn("_run", F.col("seq") - place).groupBy("session_id", "part", "_run")
            .agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
            .select(bucket_of().alias("bucket"), "session_id", "part", "low", "high"))


def merged(held: DataFrame) -> DataFrame:
    """Runs of many batches as few: those that touch or overlap become one."""
    before = Window.partitionBy("session_id", "part").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("low") <= F.max("high").over(before) + 1, 0).otherwise(1)
    order = Window.partitionBy("session_id", "part").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    return (held.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
            .groupBy("bucket", "session_id", "part", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .select("bucket", "session_id", "part", "low", "high"))


class EventLog:
    def __init__(self, spark: SparkSession, base: str, schema: StructType | None = None):
        """`schema`: of the stored events, for reads before and between batches; the files' own if not given."""
        self.spark, self.base, self.schema = spark, base.rstrip("/"), schema

    # ---- batches -------------------------------------------------------------------------------

    def commits(self) -> DataFrame | None:
        """(batch, source, source_batch, received, inserted) of every committed batch; None before the first."""
        return read_if_there(self.spark.read, f"{self.base}/commits")

    def batches(self) -> Spans:
        done = self.commits()  # one number per batch
        return [] if done is None else spans(r[0] for r in done.select("batch").distinct().collect())

    def number(self, source: str | None = None, source_batch: int | None = None) -> int:
        """The number of a new batch, or the one that this batch of a source was given before."""
        done = self.commits()
        if done is None:
            return 0
        if source is not None:
            known = done.filter((F.col("source") == source) & (F.col("source_batch") == source_batch)).agg(F.max("batch")).first()[0]
            if known is not None:
                return known
        return done.agg(F.max("batch")).first()[0] + 1

    def append(self, rows: DataFrame, source: str | None = None, source_batch: int | None = None) -> dict[str, int]:
        """Store the events of a batch that are not stored yet, once each. A batch of a source that is
        committed already is left as it is. One writer at a time is assumed."""
        number = self.number(source, source_batch)
        done = self.commits()
        known = None if done is None else done.filter(F.col("batch") == number).first()
        if known is None:
            scratch = scratch_path(self.spark, "batch")  # read for its buckets and for its new rows
            rows.write.parquet(scratch)
            received = self.spark.read.schema(rows.schema).parquet(scratch)
            events, keys = f"{self.base}/events/batch={number}", f"{self.base}/keys/batch={number}"
            # rebalanced, so that a day or a bucket is a file or a few, not one of every task
            (self.new_rows(received).withColumn("event_date", F.to_date("ts")).hint("rebalance", "event_date")
             .write.mode("overwrite").partitionBy("event_date").parquet(events))
            kept = read_if_there(self.spark.read, events)
            if kept is not None:
                runs(kept).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(keys)
            # one row per day of event time in the batch
            days = [] if kept is None else [(r["event_date"], r["count"]) for r in kept.groupBy("event_date").count().collect()]
            counts = [received.count(), sum(n for _, n in days)]
            (self.spark.createDataFrame([(source, source_batch, *counts, days)], _COMMIT).coalesce(1)
             .write.mode("overwrite").parquet(f"{self.base}/commits/batch={number}"))
            discard(self.spark, scratch)
        else:
            counts = [known["received"], known["inserted"]]
        return {"received": counts[0], "inserted": counts[1], "duplicates": counts[0] - counts[1]}

    def days(self) -> list[tuple[date, int]]:
        """(day of event time, events) of all committed batches, newest first."""
        done = self.commits()
        if done is None:
            return []
        per_day = done.select(F.explode("days").alias("d")).groupBy("d.day").agg(F.sum("d.rows").alias("rows"))
        return [(r["day"], r["rows"]) for r in per_day.filter("day is not null").orderBy(F.desc("day")).collect()]

    def read(self, numbers: Spans | None = None, days: list[date] | None = None) -> DataFrame | None:
        """Committed events, of some batches or days or all; None before the first. Others are not opened."""
        numbers = self.batches() if numbers is None else numbers
        reader = self.spark.read if self.schema is None else self.spark.read.schema(
            StructType([*self.schema.fields, *StructType.fromDDL("batch bigint, event_date date").fields]))
        rows = read_if_there(reader, f"{self.base}/events")
        if rows is None:
            return None
        rows = rows.filter(within(F.col("batch"), numbers))
        return (rows if days is None else rows.filter(F.col("event_date").isin(days))).drop("event_date")

    # ---- keys ----------------------------------------------------------------------------------

    def _merged(self) -> Versions:
        return Versions(self.spark, f"{self.base}/merged_keys")

    def keys(self, buckets: list[int] | None = None) -> DataFrame | None:
        """Runs of the stored keys in some buckets (all if not given)."""
        def of(rows: DataFrame) -> DataFrame:
            rows = rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))
            return rows.select("bucket", "session_id", "part", "low", "high")
        parts, covered = [], []
        store = self._merged()
        if (version := store.latest()) is not None:
            covered = [tuple(s) for s in store.commits().filter(F.col("version") == version).first()["batches"]]
            parts.append(of(store.read("keys", version)))
        loose = without(self.batches(), covered)
        if loose and (rows := read_if_there(self.spark.read, f"{self.base}/keys")) is not None:
            parts.append(of(rows.filter(within(F.col("batch"), loose))))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """First deliveries whose key is in no committed batch."""
        first = ingest.first_delivery(batch)
        met = [r[0] for r in batch.select(bucket_of().alias("bucket")).distinct().collect()]  # at most BUCKETS
        held = self.keys(met)
        if held is None:
            return first
        rows, keys = first.withColumn("_part", _part()).alias("r"), held.alias("k")
        same = ((F.col("r.session_id") == F.col("k.session_id")) & (F.col("r._part") == F.col("k.part"))
                & F.col("r.seq").between(F.col("k.low"), F.col("k.high")))
        return rows.join(keys, same, "left_anti").drop("_part")

    def compact(self) -> None:
        """Merge the runs of all batches, so that a new one reads few files per bucket."""
        done = self.batches()
        if not done:
            return
        store = self._merged()
        version = (store.latest() or 0) + 1
        (merged(self.keys()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(store._path("keys", version)))
        covers = F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for a, b in done])
        store.commit(version, self.spark.range(1).select(covers.alias("batches")))
