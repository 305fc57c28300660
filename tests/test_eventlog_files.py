"""Files that an append to the event log leaves."""

from pathlib import Path

from pulse.plans.eventlog import BUCKETS, EventLog


def test_files_follow_days_and_buckets_not_tasks(spark, scratch):
    rows = spark.range(0, 20_000, 1, 16).selectExpr(
        "concat('s', id % 500) AS session_id", "id div 500 AS seq", "'AreaEntered' AS type",
        "timestamp_seconds(1704067200 + (id % 20) * 86400) AS ts", "timestamp_seconds(1704067200 + id) AS received_at")
    base = scratch("files")
    log = EventLog(spark, base)
    # tasks stay as many as they are with large batches
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report = log.append(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert report == {"received": 20_000, "inserted": 20_000, "duplicates": 0}
    assert log.read().count() == 20_000

    def files(part):
        return len(list(Path(base, part).rglob("*.parquet")))

    assert files("events") <= 20 + 4 and files("keys") <= BUCKETS + 4  # one each, and what the edges of partitions add
