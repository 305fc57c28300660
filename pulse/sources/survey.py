"""World-survey manifests: tagged lines -> placements, with checks that refuse a partial survey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.plans.versions import Versions
from pulse.session import discard, scratch_path

# Fixed values of the survey format and of the controlled load order.
SURVEY_TAG = "OMWAS1 "
KINDS = ("begin", "header", "placement", "footer")
REQUIRED_FILES = ("morrowind.esm", "tribunal.esm", "bloodmoon.esm")
ENGINE_FILES = ("builtin.omwscripts",)

_LINE = ("kind STRING, load_order ARRAY<STRING>, cells_scanned BIGINT, area STRING, "
         "is_exterior BOOLEAN, item_id STRING, count BIGINT, rows BIGINT")


def parse(lines: DataFrame) -> DataFrame:
    """`lines(line, pos)` -> one row per tagged line; an unreadable body has `readable` false."""
    at = F.instr("line", SURVEY_TAG)
    body = F.col("line").substr(at + len(SURVEY_TAG), F.length("line"))
    return (lines.filter(at > 0).withColumn("_b", body)
            .select("pos", F.json_object_keys("_b").isNotNull().alias("readable"),
                    F.from_json("_b", _LINE).alias("o")).select("pos", "readable", "o.*"))


def load_order_hash(order: Column) -> Column:
    """Order-sensitive fingerprint, 16 hex digits."""
    return F.substring(F.sha2(F.array_join(order, "\n"), 256), 1, 16)


def checks(parsed: DataFrame) -> DataFrame:
    """One row: header fields, row counts, and the reasons to refuse the manifest (empty = fine)."""
    def n(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    def at(kind: str, pick) -> Column:
        return pick(F.when(F.col("kind") == kind, F.col("pos")))

    def last_of(kind: str, col: str) -> Column:
        return F.max_by(col, F.when(F.col("kind") == kind, F.col("pos")))

    started = F.least(at("header", F.min), at("placement", F.min))
    summary = parsed.agg(
        n("header").alias("headers"), n("placement").alias("placements"),
        n("footer").alias("footers"), F.count_if(~F.col("readable")).alias("unreadable"),
        F.count_if(F.col("readable") & ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))
        .alias("unknown"),
        F.coalesce(at("begin", F.max) > started, F.lit(False)).alias("second_run"),
        last_of("header", "load_order").alias("load_order"),
        F.coalesce(last_of("header", "cells_scanned"), F.lit(0)).alias("cells_scanned"),
        last_of("footer", "rows").alias("footer_rows"))
    refusals = {
        "unreadable line": F.col("unreadable") > 0,
        "unknown record kind": F.col("unknown") > 0,
        "second run in one log": F.col("second_run"),
        "no header": F.col("headers") == 0,
        "no load order": (F.col("headers") > 0) & (F.coalesce(F.size("load_order"), F.lit(0)) == 0),
        "no footer": F.col("footer_rows").isNull(),
        "row count differs from footer": F.col("footer_rows") != F.col("placements"),
    }
    return summary.withColumns({
        "load_order_hash": load_order_hash(F.col("load_order")),
        "refusals": F.array_compact(F.array(*[F.when(c, r) for r, c in refusals.items()]))})


def placements(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind") == "placement").select(
        "area", "is_exterior", F.lower("item_id").alias("item_record_id"), "count")


def load_order_verdict(order: Column, extras: Sequence[str] = ()) -> Column:
    """struct(ok, missing, contaminants): required files present, and nothing unexpected.

    The load order alone decides, names compared without case.
    """
    def names(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v.lower()) for v in values]).cast("array<string>")

    seen = F.transform(order, F.lower)
    missing = F.array_except(names(REQUIRED_FILES), seen)
    strange = F.filter(order, lambda f: ~F.array_contains(
        names((*REQUIRED_FILES, *ENGINE_FILES, *extras)), F.lower(f)))
    return F.struct(((F.size(missing) == 0) & (F.size(strange) == 0)).alias("ok"),
                    missing.alias("missing"), strange.alias("contaminants"))


def load(store: Versions, lines: DataFrame, surveyed_at: Column,
         extras: Sequence[str] = ()) -> int:
    """Replace the stored survey as a whole, or refuse and leave the old one in place.

    The lines are computed and parsed once: every check reads what was parsed then.
    """
    scratch = scratch_path(store.spark, "survey-lines")
    try:
        lines = parse(lines)
        lines.write.parquet(scratch)
        return _load_parsed(store, store.spark.read.schema(lines.schema).parquet(scratch), surveyed_at, extras)
    finally:
        discard(store.spark, scratch)


def _repeats(rows: DataFrame) -> bool:
    """Whether an (area, item) pair occurs twice. Pairs are counted by hash; only those whose hash repeats are compared."""
    pair = F.xxhash64("area", "item_record_id")
    twice = rows.groupBy(pair.alias("_pair")).count().filter("count > 1").select("_pair")
    if twice.isEmpty():
        return False
    alike = rows.withColumn("_pair", pair).join(twice, "_pair", "left_semi")
    return not alike.groupBy("area", "item_record_id").count().filter("count > 1").isEmpty()


def _load_parsed(store: Versions, parsed: DataFrame, surveyed_at: Column, extras: Sequence[str]) -> int:
    head = checks(parsed).withColumn("order", load_order_verdict(F.col("load_order"), extras))
    row = head.first()  # one aggregate row
    if row["refusals"]:
        raise ValueError(f"survey refused: {row['refusals']}")
    if not row["order"]["ok"]:
        raise ValueError(f"survey refused: load order {row['order']}")
    rows = placements(parsed)
    if _repeats(rows):
        raise ValueError("survey refused: an (area, item) pair occurs twice")
    version = (store.latest() or 0) + 1
    store.write_uncommitted("placements", version, rows)
    written = store.read("placements", version).count()
    if written != row["placements"]:
        raise ValueError(f"survey refused: {row['placements']} parsed, {written} written")
    survey_id = F.concat(F.lit("survey-"), "load_order_hash", F.lit("-"),
                         F.unix_millis(surveyed_at).cast("string"))
    store.write_uncommitted("surveys", version, store.spark.createDataFrame([row], head.schema).select(
        survey_id.alias("survey_id"), "load_order", "load_order_hash", "cells_scanned",
        surveyed_at.alias("surveyed_at")))
    store.commit(version)
    return version
