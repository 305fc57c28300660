"""Tagged log lines -> validated, normalised, de-duplicated events; plus export and upkeep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions import payload
from pulse.functions.verdicts import live_types
from pulse.operators.blocked import with_block
from pulse.operators.once import compute_once
from pulse.sources import growing

# Fixed values of the wire format.
EVENT_TAG = "OMWA1 "
MAX_DATA_KEYS = 32
MAX_DATA_BYTES = 2048
KNOWN_ENVS = ("dev", "prod")
DEFAULT_ENV = "prod"
UNKNOWN_MOD = "unknown"
MOD_ID_PATTERN = r"^[a-z0-9][a-z0-9._-]{0,63}$"
UUID_PATTERN = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-"
                r"[0-9a-fA-F]{12}$")

KEY = ["session_id", "seq"]


# ---- scan ----------------------------------------------------------------------------------------

def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Closed log files, one row per line. Streams use `streaming.ingest.read_log_stream`."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_growing_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """The complete lines of logs that may still be written, split by byte ranges."""
    growing.register(spark)
    return spark.read.format(growing.NAME).options(path=path, **options).load()


def tagged(lines: DataFrame, tag: str = EVENT_TAG) -> DataFrame:
    """Keep lines carrying the tag anywhere; `body` is the text after it."""
    at = F.instr("line", tag)
    body = F.col("line").substr(at + len(tag), F.length("line"))
    return lines.filter(at > 0).withColumn("body", F.rtrim(body))


# ---- validate ------------------------------------------------------------------------------------

# `type` and `mod_id` stay variants so that a number in place of a string is seen as a violation;
# a whole number of the wrong JSON type reads as null. `data` keeps its text.
_WIRE = ("v BIGINT, type VARIANT, seq BIGINT, install_id STRING, session_id STRING, ts BIGINT, "
         "mod_id VARIANT, data STRING")


def _string(col: Column) -> Column:
    return F.when(F.schema_of_variant(col) == "STRING", F.try_variant_get(col, "$", "string"))


def validate(rows: DataFrame) -> DataFrame:
    """Envelope columns plus `violations`, the names of every rule the row breaks.

    The body is parsed once. Rows are judged one by one: a bad event is quarantined without
    rejecting its batch.
    """
    # a body without "}" holds no whole object: to fail at it costs more than to parse
    body = F.when(F.contains("body", F.lit("}")), F.col("body"))
    typed = (compute_once(rows, _e=F.from_json(body, _WIRE), _readable=F.json_object_keys(body).isNotNull())
             .select(*rows.columns, "_readable", F.col("_e.v").alias("v"),
                     _string(F.col("_e.type")).alias("type"), F.col("_e.seq").alias("seq"),
                     F.lower("_e.install_id").alias("install_id"),
                     F.lower("_e.session_id").alias("session_id"), F.col("_e.ts").alias("ts_ms"),
                     _string(F.col("_e.mod_id")).alias("mod_id_raw"),
                     F.col("_e.mod_id").isNotNull().alias("_mod"),
                     F.coalesce("_e.data", F.lit("{}")).alias("data")))
    ok = {
        "v": F.col("v") > 0,
        "type": F.col("type") != "",
        "seq": F.col("seq") >= 0,
        "install_id": F.col("install_id").rlike(UUID_PATTERN),
        "session_id": F.col("session_id").rlike(UUID_PATTERN),
        "ts": F.col("ts_ms") > 0,
        "mod_id": ~F.col("_mod") | F.col("mod_id_raw").isNotNull(),
        "data": F.col("data").startswith("{"),
        # a key takes five bytes at least, `"":0,`: shorter payloads need not be parsed
        "data_keys": (F.octet_length("data") < 5 * MAX_DATA_KEYS)
                     | (F.coalesce(F.size(F.json_object_keys("data")), F.lit(0)) <= MAX_DATA_KEYS),
        "data_bytes": F.octet_length("data") <= MAX_DATA_BYTES,
    }
    broken = F.array_compact(F.array(
        *[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in ok.items()]))
    # an unreadable payload breaks every rule; it is reported as that one cause
    return typed.withColumn("violations", F.when(~F.col("_readable"), F.array(F.lit("payload")))
                            .otherwise(broken)).drop("_mod", "_readable")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") == 0)


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") > 0)


def violation_counts(validated: DataFrame) -> DataFrame:
    return (validated.select(F.explode_outer("violations").alias("violation"))
            .groupBy(F.coalesce("violation", F.lit("none")).alias("violation"))
            .agg(F.count("*").alias("rows")))


# ---- normalise -----------------------------------------------------------------------------------

def stamp_env(header: Column) -> Column:
    cleaned = F.lower(F.trim(header))
    return F.when(cleaned.isin(*KNOWN_ENVS), cleaned).otherwise(DEFAULT_ENV)


def normalise_mod_id(raw: Column) -> Column:
    """A malformed id is relabelled, never a reason to lose the event."""
    cleaned = F.lower(F.trim(raw))
    return F.when(cleaned.rlike(MOD_ID_PATTERN), cleaned).otherwise(UNKNOWN_MOD)


def promote(events: DataFrame) -> DataFrame:
    """Hot payload keys as columns, computed here and nowhere else."""
    return events.withColumns({k: payload.typed(k, kind) for k, kind in payload.PROMOTED.items()})


def to_events(valid: DataFrame, env_header: Column, received_at: Column) -> DataFrame:
    """Accepted envelope rows -> silver columns."""
    rows = valid.select(
        "install_id", "session_id", "seq", "type", F.col("v").cast("int").alias("v"),
        F.timestamp_millis("ts_ms").alias("ts"), received_at.alias("received_at"),
        stamp_env(env_header).alias("env"), normalise_mod_id(F.col("mod_id_raw")).alias("mod_id"),
        "data")
    return with_block(promote(rows))


# ---- idempotent append ---------------------------------------------------------------------------

def first_delivery(events: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per (session_id, seq): the earliest delivery, with all or the named columns.

    An aggregate, not a window: copies collapse on the map side, so a delivery repeated any
    number of times never meets in one task. Columns that are not asked for are not sorted and shuffled.
    """
    columns = list(columns or events.columns)
    rest = [c for c in events.columns if c not in KEY]
    # the whole row as last tie-break keeps the choice stable when a stage is run again
    age = F.struct("received_at", F.xxhash64(*rest).alias("tie"))
    kept = events.select(*KEY, age.alias("_age"), F.struct(*[c for c in columns if c not in KEY]).alias("_row"))
    return kept.groupBy(*KEY).agg(F.min_by("_row", "_age").alias("_row")).select(*KEY, "_row.*").select(*columns)


def new_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """First deliveries whose key is not in `stored`. A standing store is an `plans.eventlog.EventLog`, which
    reads runs of keys instead."""
    return first_delivery(batch).join(stored.select(*KEY), KEY, "left_anti")


def ingest_report(batch: DataFrame, stored: DataFrame) -> DataFrame:
    received = batch.agg(F.count("*").alias("received"))
    inserted = new_rows(batch.select(*KEY, "received_at"), stored).agg(
        F.count("*").alias("inserted"))
    return received.crossJoin(F.broadcast(inserted)).withColumn(
        "duplicates", F.col("received") - F.col("inserted"))


# ---- registry, heartbeats ------------------------------------------------------------------------

def mod_registry(events: DataFrame) -> DataFrame:
    """Mods observed so far: a cache of what arrived, not an allow-list."""
    return events.groupBy("mod_id").agg(F.min("received_at").alias("first_seen_at"),
                                        F.max("received_at").alias("last_seen_at"))


def latest_heartbeats(pings: DataFrame) -> DataFrame:
    """Newest state per install; a ping without a seq or version keeps the last known one."""
    def known(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seen_at"))).alias(name)

    # any 36 hex-or-dash characters: the heartbeat check is looser than the envelope's
    valid = pings.filter(F.trim("install_id").rlike("(?i)^[0-9a-f-]{36}$")).select(
        F.trim("install_id").alias("install_id"), "seen_at", "last_shipped_seq",
        F.substring("shipper_version", 1, 64).alias("shipper_version"))
    return valid.groupBy("install_id").agg(F.max("seen_at").alias("last_seen_at"),
                                           known("last_shipped_seq"), known("shipper_version"))


# ---- export and re-attribution -------------------------------------------------------------------

def export_rows(events: DataFrame) -> DataFrame:
    """Everything but retired types, in event-time order, timestamps as epoch milliseconds."""
    return (events.filter(live_types())
            .orderBy("ts", "session_id", "seq")
            .withColumns({"ts": F.unix_millis("ts"), "received_at": F.unix_millis("received_at")}))


def export_summary(events: DataFrame) -> DataFrame:
    return events.filter(live_types()).groupBy("type").agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))


def attribute(events: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Fill in the mod of events that have none, by type. The mapping is a small constant."""
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]),
                              F.col("type"))
    return events.withColumn("mod_id", F.when(F.col("mod_id") == UNKNOWN_MOD,
                                              F.coalesce(target, F.col("mod_id")))
                             .otherwise(F.col("mod_id")))


def attribution_preview(events: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Dry run: counts by (mod, type) before and after."""
    after = attribute(events.withColumn("_was", F.col("mod_id")), mapping)
    return after.groupBy(F.col("_was").alias("mod_before"), F.col("mod_id").alias("mod_after"),
                         "type").agg(F.count("*").alias("events"))


def write_snapshot(result: DataFrame, path: str, captured_at: Column) -> None:
    """Replace a stored result; an empty one is refused so it cannot wipe a good snapshot."""
    if result.isEmpty():
        raise ValueError("refusing to replace a snapshot with an empty result")
    result.withColumn("captured_at", captured_at).write.mode("overwrite").json(path)
