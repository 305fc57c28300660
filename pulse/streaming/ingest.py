"""Streaming ingest: live or closed log files -> validated events in Parquet, each stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulse.plans.eventlog import EventLog
from pulse.sources import growing, ingest
from pulse.sources.schemas import EVENTS

# Periodic trigger of the standing jobs.
EVERY = "5 minutes"


def read_log_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Lines of live logs as they are completed; logs that are cut or replaced are read anew."""
    growing.register(spark)
    return spark.readStream.format(growing.NAME).options(path=folder, **options).load()


def read_closed_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of log files that no one writes to any more, from any store that Spark reads; each path is read once."""
    return (spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
            .withColumnRenamed("value", "line"))


def drop_repeats(events: DataFrame, within: str = "1 hour", key: tuple[str, ...] = tuple(ingest.KEY)) -> DataFrame:
    """First delivery of each event, with state bounded by the watermark on arrival time.

    Retries usually come soon, so this removes most of them before the stored keys are consulted.
    """
    return (events.withWatermark("received_at", within)
            .dropDuplicatesWithinWatermark(list(key)))


def _recent(checked: DataFrame, within: str) -> DataFrame:
    """Checked lines without recent repeats: an event is known by its key, a bad line by its text."""
    good = F.size("violations") == 0
    keyed = checked.withColumns({"_session": F.when(good, F.col("session_id")).otherwise(F.sha2("line", 256)),
                                 "_seq": F.when(good, F.col("seq")).otherwise(-1)})
    return drop_repeats(keyed, within, ("_session", "_seq")).drop("_session", "_seq")


def event_log(spark: SparkSession, base: str) -> EventLog:
    return EventLog(spark, base, EVENTS)


def _append(checked: DataFrame, batch_id: int, base: str, env: str) -> None:
    spark = checked.sparkSession
    (ingest.quarantined(checked).select("line", "violations")
     .write.mode("overwrite").json(f"{base}/quarantine/batch={batch_id}"))
    events = ingest.to_events(ingest.accepted(checked), F.lit(env), F.col("received_at"))
    # a micro-batch that is run again keeps its number; outside a stream every call is a batch of its own
    source = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    event_log(spark, base).append(events, source, batch_id)


def checked_lines(lines: DataFrame) -> DataFrame:
    return ingest.validate(ingest.tagged(lines)).withColumn("received_at", F.current_timestamp())


def append_batch(lines: DataFrame, batch_id: int, base: str, env: str) -> None:
    """One micro-batch. Running it again changes nothing: events are matched against the stored keys,
    and the quarantine of a batch is replaced as a whole."""
    _append(checked_lines(lines), batch_id, base, env)


def start_ingest(lines: DataFrame, base: str, env: str = ingest.DEFAULT_ENV, checkpoint: str | None = None,
                 every: str | None = EVERY, retries: str | None = "1 hour") -> StreamingQuery:
    """Run the ingest. `every=None` processes what is there and stops. `retries`: how long the stream itself
    remembers events; later repeats are told by the stored keys (None: all are).

    The offset advances only after a batch is written, so delivery is at least once and the append makes
    it exactly once.
    """
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    checked = checked_lines(lines)
    checked = checked if retries is None else _recent(checked, retries)
    return (checked.writeStream.foreachBatch(lambda df, n: _append(df, n, base, env))
            .option("checkpointLocation", checkpoint or f"{base}/_checkpoints/ingest")
            .trigger(**trigger).start())


def read_events(spark: SparkSession, base: str) -> DataFrame:
    """Committed events, each once."""
    rows = event_log(spark, base).read()
    return spark.createDataFrame([], EVENTS) if rows is None else rows.drop("batch")


def start_fold(pings: DataFrame, store, events, as_of, checkpoint: str,
               every: str = EVERY) -> StreamingQuery:
    """Fold settled sessions on a fixed cadence. `pings` is any slow stream (such as `rate`): it
    only keeps time. A run that is still busy delays the next one, so folds never overlap.

    `events` is an `EventLog`, of which a run reads the new batches, or makes a DataFrame of all events.
    """
    from pulse.plans import rollup

    def run(_, __):
        if isinstance(events, EventLog):
            rollup.fold_changes(store, events, as_of())
        else:
            rollup.fold(store, events(), as_of())
    return (pings.writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(processingTime=every).start())
