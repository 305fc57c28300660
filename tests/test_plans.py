"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from pulse.operators import explorer, sequence, stats, vector
from pulse.sources import schemas


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def silver(spark, tables, scratch):
    """Events as the ingest writes them, with seq and block stored."""
    path = scratch("silver")
    tables.telemetry().withColumn("event_date", F.to_date("ts")).write.partitionBy(
        "event_date").parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(silver):
    text = plan(stats.by_topic(silver))
    assert re.search(r"PushedFilters: \[IsNotNull\(type\), EqualTo\(type,Confront", text)
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"type", "suspect", "topic", "passed"}


def test_failures_are_selected_after_the_window(silver):
    text = plan(sequence.failed_with_next(silver))
    window = text.index("Window [lead")
    # the plan is printed top-down: the failure filter stands above the window; below it only the
    # retired types are filtered, so an attempt's successor can be of any type
    assert text.index("ConfrontationAttempted") < window
    below = text[window:]
    assert "ConfrontationAttempted" not in below
    assert "Heartbeat" in below and "SpikeStarted" in below


def test_after_failure_shuffles_events_once(silver):
    """One exchange of the event stream; the edge repair starts from `block > 0` at the scan."""
    text = plan(sequence.after_failure_partials(silver))
    assert len(re.findall(r"hashpartitioning\(session_id#\d+, block#\d+L", text)) <= 3
    assert "GreaterThan(block,0)" in text


def test_page_is_a_bounded_top_n_with_a_pushed_bound(silver):
    cursor = explorer.Cursor(1_704_500_000_000_000, "a", 1).encode()
    text = plan(explorer.page(silver, {"type": "AreaEntered"}, cursor, 50))
    assert "TakeOrderedAndProject" in text and "LessThanOrEqual(ts," in text


def test_top_k_is_cut_before_the_shuffle(tables):
    found = vector.nearest(tables.vectors(), tables.query_vectors(), 5)
    assert "WindowGroupLimit" in plan(found)


def test_no_pair_of_gate_and_remedy_is_built(tables):
    from pulse.plans import catalog
    catalog.load()
    text = plan(catalog.QUERIES["gate_sufficiency"](tables))
    assert "CartesianProduct" not in text
    # nested-loop joins occur only against one-row scalars
    assert text.count("BroadcastNestedLoopJoin") <= 2


def test_envelope_schema_names():
    assert {"session_id", "seq", "block", "data"} <= set(schemas.EVENTS.fieldNames())


def test_dump_rows_are_read_once(spark, tables):
    from pulse.sources import dump
    files = dump.parse(tables.dump_rows()).inputFiles()
    # the regular expressions ran when the rows were written; what is left reads that table
    assert files and all("/dump-rows-" in f for f in files)


def test_a_hybrid_read_takes_folded_sessions_from_the_store(spark, tables):
    from pulse.plans import catalog
    catalog.load()
    files = catalog.QUERIES["hybrid_attempts_to_pass"](tables).inputFiles()
    assert {"attempts", "sessions_done", "commits"} <= {part for f in files for part in f.split("/")}
