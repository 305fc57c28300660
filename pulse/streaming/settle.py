"""Stateful fold: one result per session, emitted when it has been silent for the allowed lateness.

The session is digested as it arrives. Sequence numbers are dense, so events are consumed in order
as soon as they are contiguous and only the out-of-order remainder is buffered; running counters
hold the rest. State is bounded by disorder and by the number of buckets, not by session length.
Events of a session that was already emitted come out as `late` rows and change nothing; a session is
forgotten `FORGET` after that, and what comes later still is told by comparing with the fold log.

`start_settle` commits what settles to the rollup, one version for each micro-batch that has any.

Silence is measured on the arrival watermark (for replays) or on the clock of the job, which goes on
when traffic stops (for the standing job).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor,
                                                      StatefulProcessorHandle)

from pulse.functions.verdicts import RETIRED_TYPES
from pulse.plans import rollup
from pulse.plans.versions import Versions

FORGET = timedelta(days=2)

OUTPUT = ("session_id string, kind string, install_id string, suspect string, topic string, "
          "next_action string, count long, gap_count long, sum_gap_us long, total_attempts long, "
          "attempts_to_pass long, seq long, env string, mod_id string, events long, last_ms long")
COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]

EVENT = ("type string, suspect string, topic string, passed boolean, completed boolean, "
         "ts_us long, received_ms long, env string, mod_id string")
FIELDS = [part.split()[0] for part in EVENT.split(", ")]
# next_seq, newest arrival, whether emitted, the failed attempt waiting for its successor (with its scope),
# and the number of events consumed
PROGRESS = ("next_seq long, last_ms long, emitted boolean, install_id string, waiting boolean, "
            "suspect string, topic string, ts_us long, env string, mod_id string, events long")
BUCKET_KEY = "env string, mod_id string, suspect string, topic string, next_action string"


def bucket(suspect, topic, event: dict) -> str:
    """`verdicts.next_action` for one pair of events; unknown values never equal each other."""
    kind = event["type"]
    if kind == "ConfrontationAttempted":
        known = None not in (suspect, topic)
        same = known and (event["suspect"], event["topic"]) == (suspect, topic)
        return "retried_same" if same else "switched_topic"
    if kind == "ConfrontationExited":
        return "exited_solved" if event["completed"] else "abandoned"
    return "left_area" if kind == "AreaEntered" else "other"


def row(**values) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([values.get(c)], dtype="object") for c in COLUMNS})


class SettleSessions(StatefulProcessor):
    def __init__(self, idle_ms: int | None, forget_ms: int):
        """`idle_ms`: silence on the job's clock; None waits for the arrival watermark."""
        self.idle_ms, self.forget_ms = idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", PROGRESS)
        self.buffer = handle.getMapState("buffer", "seq long", EVENT)
        self.buckets = handle.getMapState("buckets", BUCKET_KEY,
                                          "count long, gap_count long, sum_gap_us long")
        self.tries = handle.getMapState("tries", "suspect string, topic string",
                                        "total long, won long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        state = self._load()
        late = []
        for batch in rows:
            for event in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                if state["emitted"]:
                    late.append(event["seq"])
                    continue
                state["install_id"] = state["install_id"] or event["install_id"]
                state["last_ms"] = max(state["last_ms"], event["received_ms"])
                if event["seq"] >= state["next_seq"]:  # a repeat of a consumed event is dropped
                    self.buffer.updateValue((int(event["seq"]),),
                                            tuple(event[f] for f in FIELDS))
        if late:
            for seq in late:
                yield row(session_id=key[0], kind="late", install_id=state["install_id"], seq=seq)
            return
        while self.buffer.containsKey((state["next_seq"],)):
            found = self.buffer.getValue((state["next_seq"],))
            self.buffer.removeKey((state["next_seq"],))
            self._consume(state, dict(zip(FIELDS, found)))
            state["next_seq"] += 1
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        # the watermark already trails the newest arrival by the allowed lateness
        self.handle.registerTimer(state["last_ms"] if self.idle_ms is None else
                                  timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        self._save(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo: ExpiredTimerInfo):
        state = self._load()
        if state["emitted"]:
            self.progress.clear()
            return
        # whatever is still missing was lost on the way; the rest is consumed in order
        for (seq,), found in sorted((tuple(k), tuple(v)) for k, v in self.buffer.iterator()):
            self._consume(state, dict(zip(FIELDS, found)))
        if state["waiting"]:
            self._count(state, "session_end", None)
        yield row(session_id=key[0], kind="session", install_id=state["install_id"], events=state["events"],
                  last_ms=state["last_ms"])
        for (env, mod, suspect, topic, action), (count, gaps, total) in self.buckets.iterator():
            yield row(session_id=key[0], kind="after_failure", install_id=state["install_id"],
                      env=env, mod_id=mod, suspect=suspect, topic=topic, next_action=action, count=count,
                      gap_count=gaps, sum_gap_us=total)
        for (suspect, topic), (total, won) in self.tries.iterator():
            yield row(session_id=key[0], kind="attempts", install_id=state["install_id"],
                      suspect=suspect, topic=topic, total_attempts=total,
                      attempts_to_pass=won or None)
        for part in (self.buffer, self.buckets, self.tries):
            part.clear()
        state.update(emitted=True, waiting=False)
        self._save(state)
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.forget_ms)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        names = [part.split()[0] for part in PROGRESS.split(", ")]
        if self.progress.exists():
            return dict(zip(names, self.progress.get()))
        return dict(zip(names, (0, 0, False, None, False, None, None, None, None, None, 0)))

    def _save(self, state: dict) -> None:
        self.progress.update(tuple(state.values()))

    def _count(self, state: dict, action: str, ts_us: int | None) -> None:
        at = (state["env"], state["mod_id"], state["suspect"], state["topic"], action)
        count, gaps, total = (self.buckets.getValue(at) if self.buckets.containsKey(at)
                              else (0, 0, 0))
        gap = 0 if ts_us is None else ts_us - state["ts_us"]
        self.buckets.updateValue(at, (count + 1, gaps + (ts_us is not None), total + gap))

    def _consume(self, state: dict, event: dict) -> None:
        state["events"] += 1
        if event["type"] in RETIRED_TYPES:
            return
        if state["waiting"]:
            self._count(state, bucket(state["suspect"], state["topic"], event), event["ts_us"])
            state["waiting"] = False
        if event["type"] != "ConfrontationAttempted":
            return
        at = (event["suspect"], event["topic"])
        total, won = self.tries.getValue(at) if self.tries.containsKey(at) else (0, 0)
        total += 1
        self.tries.updateValue(at, (total, won or (total if event["passed"] else 0)))
        if event["passed"] is False:
            state.update(waiting=True, suspect=at[0], topic=at[1], ts_us=event["ts_us"], env=event["env"], mod_id=event["mod_id"])


def settle(events: DataFrame, lateness: str = "10 minutes", idle: timedelta | None = None,
           forget: timedelta = FORGET) -> DataFrame:
    """Streaming events -> one `session` row, one `after_failure` row per bucket and one `attempts` row per
    subject of each settled session, plus `late` rows. Events without env or mod_id have null ones.

    A session settles when the arrival watermark has passed its newest event by `lateness`, or, with
    `idle`, when the job has heard nothing of it for so long.
    """
    watermarked = events.withWatermark("received_at", lateness) if idle is None else events
    watermarked = watermarked.withColumns({c: F.lit(None).cast("string") for c in ("env", "mod_id") if c not in events.columns})
    narrow = watermarked.select(
        "session_id", "install_id", "seq", "type", "suspect", "topic", "passed", "completed",
        F.unix_micros("ts").alias("ts_us"), F.unix_millis("received_at").alias("received_ms"),
        "env", "mod_id", "received_at")

    def ms(span: timedelta) -> int:
        return int(span.total_seconds() * 1000)
    return narrow.groupBy("session_id").transformWithStateInPandas(
        SettleSessions(None if idle is None else ms(idle), ms(forget)), OUTPUT, "Append",
        "EventTime" if idle is None else "ProcessingTime")


def start_settle(events: DataFrame, store: Versions, checkpoint: str, lateness: str = "10 minutes",
                 idle: timedelta | None = None, forget: timedelta = FORGET, every: str | None = None) -> StreamingQuery:
    """Fold sessions into the rollup as they settle. `every=None` processes what is there and stops.

    A micro-batch is committed under its own number, so one that is run again changes nothing, and one that
    died before its commit is written over. The store is this stream's alone; `rollup.friction_read` reads it.
    """
    def commit(rows: DataFrame, batch: int) -> None:
        source = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rollup.commit_settled(store, rows, source, batch)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (settle(events, lateness, idle, forget).writeStream.outputMode("append").foreachBatch(commit)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
