"""Event explorer (keyset pages) and freshness of the shippers."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.scope import explorer_filters

DEFAULT_PAGE, MAX_PAGE = 50, 200
STALE_AFTER_MINUTES = 120
ORDER = ("ts", "session_id", "seq")


class Cursor(NamedTuple):
    ts_us: int
    session_id: str
    seq: int

    def encode(self) -> str:
        return base64.urlsafe_b64encode("|".join(map(str, self)).encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, raw: str) -> Cursor:
        """A malformed cursor is an error; falling back to page 1 would loop a client forever."""
        try:
            padded = raw + "=" * (-len(raw) % 4)
            ts_us, session_id, seq = base64.urlsafe_b64decode(padded).decode().split("|")
            if not session_id:
                raise ValueError("empty session")
            return cls(int(ts_us), session_id, int(seq))
        except (ValueError, binascii.Error) as error:
            raise ValueError("invalid cursor") from error


def page_size(requested: int | None) -> int:
    return DEFAULT_PAGE if requested is None else min(max(int(requested), 1), MAX_PAGE)


def page(events: DataFrame, filters: Mapping[str, object] | None = None,
         cursor: str | None = None, size: int | None = None) -> DataFrame:
    """Newest first, one row more than the page so the caller can tell whether more follow.

    Total order (ts, session_id, seq); the plain `ts` bound repeats what the tuple comparison
    implies, because only a plain bound reaches the Parquet scan.
    """
    rows = events.filter(explorer_filters(filters or {}))
    if cursor:
        at = Cursor.decode(cursor)
        ts = F.timestamp_micros(F.lit(at.ts_us))
        earlier = (F.struct(*ORDER) < F.struct(
            ts.alias("ts"), F.lit(at.session_id).alias("session_id"),
            F.lit(at.seq).cast("long").alias("seq")))
        rows = rows.filter((F.col("ts") <= ts) & earlier)
    return rows.orderBy(*[F.desc(c) for c in ORDER]).limit(page_size(size) + 1)


def newest_page(log, filters: Mapping[str, object] | None = None, cursor: str | None = None,
                size: int | None = None) -> DataFrame | None:
    """`page` of an event log (`plans.eventlog.EventLog`) that opens its newest days only; None before any event.

    Days are taken from the newest (or from the cursor's) until they hold a whole page: every event of a day
    left out is older than all of these. Their row counts give the first guess, which doubles as long as
    too few rows pass the filters.
    """
    days = log.days()
    if cursor:
        last = datetime.fromtimestamp(Cursor.decode(cursor).ts_us // 1_000_000, timezone.utc).date()
        days = [(day, n) for day, n in days if day <= last]
    wanted, take, held = page_size(size) + 1, 0, 0
    while take < len(days) and held < wanted:
        held += days[take][1]
        take += 1
    while True:
        rows = log.read(days=[day for day, _ in days[:take]])
        if rows is None:
            return None
        found = page(rows, filters, cursor, size)
        if take >= len(days) or found.count() == wanted:
            return found
        take *= 2


def next_cursor(fetched: list, size: int | None = None) -> str | None:
    """Cursor after a fetched page (at most `MAX_PAGE + 1` rows), or None at the end."""
    n = page_size(size)
    if len(fetched) <= n:
        return None
    last = fetched[n - 1]
    return Cursor(last["ts_us"], last["session_id"], last["seq"]).encode()


def shipper_freshness(heartbeats: DataFrame, as_of: Column) -> DataFrame:
    minutes = F.round((as_of.cast("double") - F.col("last_seen_at").cast("double")) / 60)
    return heartbeats.withColumn("minutes_since", minutes.cast("long")).withColumn(
        "stale", F.col("minutes_since") > STALE_AFTER_MINUTES)


def freshness_report(heartbeats: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """One row. No heartbeats at all is not ok: silence is not health."""
    state = shipper_freshness(heartbeats, as_of).agg(
        F.count("*").alias("shippers"), F.count_if("stale").alias("stale_shippers"))
    newest = events.agg(F.max("received_at").alias("newest_event_at"))
    return state.crossJoin(F.broadcast(newest)).withColumns({
        "ok": (F.col("shippers") > 0) & (F.col("stale_shippers") == 0),
        "stale_after_minutes": F.lit(STALE_AFTER_MINUTES)})
