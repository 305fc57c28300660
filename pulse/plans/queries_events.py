"""Registered queries: ingest, explorer, flow and the questions asked of the raw stream."""

from datetime import datetime

from pyspark.sql import functions as F

from pulse.functions import payload
from pulse.operators import explorer, flow, sequence
from pulse.operators.once import compute_once
from pulse.operators.sufficiency import placement_tally
from pulse.plans.catalog import query
from pulse.plans.eventlog import EventLog
from pulse.plans.queries_rollup import folded_store
from pulse.plans.twin import CONTENT, EXPLORATION, FEED, TELEMETRY, sql
from pulse.session import scratch_path, stored
from pulse.sources import ingest

AS_OF = datetime(2024, 1, 31)  # fixed, so results can be reproduced
AS_OF_US = "epoch_us(TIMESTAMP '2024-01-31')"

UUID = """'{0}'"""


def uuid_sql(col: str) -> str:
    h = f"md5({col})"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-4' || substr({h},14,3) || '-8' || "
            f"substr({h},18,3) || '-' || substr({h},21,12))")


def parsed(t):
    return ingest.validate(ingest.tagged(t.log_lines()))


def deliveries(t):
    return ingest.to_events(ingest.accepted(parsed(t)), F.col("env_header"),
                            F.col("received_at"))


# ---- ingest --------------------------------------------------------------------------------------

@query("log_scan", sql(TELEMETRY, body="""
SELECT 'none' AS violation, 2 * count(*) AS rows FROM telemetry
UNION ALL SELECT 'payload', count(*) FROM telemetry"""))
def _(t):
    return ingest.violation_counts(parsed(t))


@query("growing_log", sql(TELEMETRY, body="""
SELECT type, 2 * count(*) AS lines, CAST(2 * sum(seq) AS BIGINT) AS seq_sum FROM telemetry GROUP BY type
UNION ALL SELECT 'none', 2 * count(*), NULL FROM telemetry"""))
def _(t):
    # the log as files, read as live ones in ranges that cut lines; `none` are the untagged and broken lines
    folder = scratch_path(t.spark, "logs")
    t.log_lines().select("line").write.text(folder)
    rows = ingest.read_growing_log(t.spark, folder, range_bytes=100_000)
    # a line without "}" holds no whole object: to fail at it costs more than to parse
    body = F.when((F.instr("line", ingest.EVENT_TAG) > 0) & F.contains("line", F.lit("}")),
                  F.substring_index("line", ingest.EVENT_TAG, -1))
    marked = compute_once(rows.select("line"), event=F.try_parse_json(body))
    kind = F.try_variant_get("event", "$.type", "string")
    seq = F.try_variant_get("event", "$.seq", "bigint")
    return marked.groupBy(F.coalesce(kind, F.lit("none")).alias("type")).agg(
        F.count("*").alias("lines"), F.sum(seq).alias("seq_sum"))


@query("log_ingest", sql(TELEMETRY, body=f"""
SELECT {uuid_sql("session_id")} AS session_id, seq, type,
  CASE WHEN env IN ('dev', 'prod') THEN env ELSE 'prod' END AS env, mod_id, ts_us // 1000 AS ts_ms,
  received_us // 1000 AS received_ms, suspect, topic, reason, passed
FROM telemetry"""))
def _(t):
    named = ("session_id", "seq", "type", "env", "mod_id", "ts", "received_at", "suspect", "topic", "reason", "passed")
    return ingest.first_delivery(deliveries(t), named).select(
        "session_id", "seq", "type", "env", "mod_id", F.unix_millis("ts").alias("ts_ms"),
        F.unix_millis("received_at").alias("received_ms"), "suspect", "topic", "reason", "passed")


@query("envelope_violations", """
SELECT CASE k % 8 WHEN 0 THEN 'v' WHEN 1 THEN 'type' WHEN 2 THEN 'seq' WHEN 3 THEN 'install_id'
  WHEN 4 THEN 'ts' WHEN 5 THEN 'data' WHEN 6 THEN 'data_keys' ELSE 'none' END AS violation,
  count(*) AS rows
FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY ALL""")
def _(t):
    # one field of each event is damaged, by payload number
    k = F.col("k") % 8
    wide = F.to_json(F.map_from_entries(F.transform(
        F.sequence(F.lit(1), F.lit(33)),
        lambda i: F.struct(F.concat(F.lit("key"), i.cast("string")), i))))
    good = "00000000-0000-4000-8000-000000000000"
    line = F.concat(
        F.lit('OMWA1 {"v":'), F.when(k == 0, "0").otherwise("1"),
        F.lit(',"type":"'), F.when(k == 1, "").otherwise("AreaEntered"),
        F.lit('","seq":'), F.when(k == 2, "-1").otherwise("5"),
        F.lit(',"install_id":"'), F.when(k == 3, "nobody").otherwise(good),
        F.lit(f'","session_id":"{good}","ts":'), F.when(k == 4, '"1700"').otherwise("1700"),
        F.lit(',"data":'), F.when(k == 5, "[1]").when(k == 6, wide).otherwise('{"area":"x"}'),
        F.lit("}"))
    return ingest.violation_counts(ingest.validate(ingest.tagged(
        t.feed().select(line.alias("line")))))


@query("payload_bytes", """
SELECT CASE WHEN k % 3 = 0 THEN 'data_bytes' ELSE 'none' END AS violation, count(*) AS rows
FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY ALL""")
def _(t):
    # payloads just below and just above the limit in bytes; the text has two bytes a character
    good = "00000000-0000-4000-8000-000000000000"
    text = F.repeat(F.lit("é"), F.when(F.col("k") % 3 == 0, 1021).otherwise(1020))
    line = F.concat(F.lit(f'OMWA1 {{"v":1,"type":"AreaEntered","seq":5,"install_id":"{good}","session_id":"{good}","ts":1700,"data":{{"a":"'),
                    text, F.lit('"}}'))
    return ingest.violation_counts(ingest.validate(ingest.tagged(t.feed().select(line.alias("line")))))


@query("provenance_stamp", sql(FEED, body="""
SELECT CASE k % 4 WHEN 0 THEN 'dev' ELSE 'prod' END AS env, count(*) AS events
FROM feed GROUP BY ALL"""))
def _(t):
    headers = F.element_at(F.array(F.lit(" DEV "), F.lit("Prod"), F.lit("staging"),
                                   F.lit(None).cast("string")), F.col("k") % 4 + 1)
    return t.feed().groupBy(ingest.stamp_env(headers).alias("env")).agg(
        F.count("*").alias("events"))


@query("mod_id_normalise", sql(FEED, body="""
SELECT CASE k % 5 WHEN 0 THEN 'casefile' WHEN 1 THEN 'a.b_c-1' ELSE 'unknown' END AS mod_id,
  count(*) AS events
FROM feed GROUP BY ALL"""))
def _(t):
    raw = F.element_at(F.array(F.lit(" CaseFile "), F.lit("a.b_c-1"), F.lit("-leading"),
                               F.repeat(F.lit("x"), F.lit(65)), F.lit(None).cast("string")),
                       F.col("k") % 5 + 1)
    return t.feed().groupBy(ingest.normalise_mod_id(raw).alias("mod_id")).agg(
        F.count("*").alias("events"))


_appended: dict[tuple, EventLog] = {}


def appended_log(t) -> EventLog:
    """The event log after the first half of the month was appended; written once for each session and state of
    the table."""
    key = (t.spark.sparkContext.applicationId, t.folder, t.stamp("events"))
    if key not in _appended:
        log = EventLog(t.spark, scratch_path(t.spark, "appended"))
        log.append(deliveries(t).filter(F.col("ts") < "2024-01-16"))
        _appended[key] = log
    return _appended[key]


@query("idempotent_append", sql(TELEMETRY, body="""
SELECT type, count(*) AS events, CAST(sum(seq) AS BIGINT) AS seq_sum FROM telemetry
WHERE ts_us // 1000 >= epoch_ms(TIMESTAMP '2024-01-16') GROUP BY ALL"""))
def _(t):
    return appended_log(t).new_rows(stored(deliveries(t), "batch")).groupBy("type").agg(
        F.count("*").alias("events"), F.sum("seq").alias("seq_sum"))


@query("ingest_report", sql(TELEMETRY, body="""
SELECT 2 * count(*) AS received,
  count(*) FILTER (WHERE ts_us // 1000 >= epoch_ms(TIMESTAMP '2024-01-16')) AS inserted,
  2 * count(*) - count(*) FILTER (WHERE ts_us // 1000 >= epoch_ms(TIMESTAMP '2024-01-16'))
    AS duplicates
FROM telemetry"""))
def _(t):
    batch = stored(deliveries(t).select(*ingest.KEY, "received_at"), "batch")
    received = batch.agg(F.count("*").alias("received"))
    inserted = appended_log(t).new_rows(batch).agg(F.count("*").alias("inserted"))
    return received.crossJoin(F.broadcast(inserted)).withColumn("duplicates", F.col("received") - F.col("inserted"))


@query("stored_keys", sql(TELEMETRY, body=f"""
SELECT {uuid_sql("session_id")} AS session_id, CAST(min(seq) AS BIGINT) AS low, CAST(max(seq) AS BIGINT) AS high, count(*) AS events
FROM telemetry WHERE ts_us // 1000 < epoch_ms(TIMESTAMP '2024-01-16') GROUP BY ALL"""))
def _(t):
    # the runs of sequence numbers that the log keeps, by session
    return appended_log(t).keys().groupBy("session_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("high") - F.col("low") + 1).alias("events"))


@query("mod_registry", sql(TELEMETRY, body="""
SELECT mod_id, min(received_us) // 1000 AS first_seen_ms, max(received_us) // 1000 AS last_seen_ms
FROM telemetry GROUP BY ALL"""))
def _(t):
    return ingest.mod_registry(t.unordered()).select(
        "mod_id", F.unix_millis("first_seen_at").alias("first_seen_ms"),
        F.unix_millis("last_seen_at").alias("last_seen_ms"))


def _pings(t):
    """Each event doubles as a ping of its install; odd payload numbers know no seq."""
    k = F.col("k")
    return t.feed().select(
        F.concat(F.lit(" 00000000-0000-4000-8000-"),
                 F.lpad(F.col("install_id"), 12, "0")).alias("install_id"),
        F.col("ts").alias("seen_at"),
        F.when(k % 2 == 0, F.col("event_id")).alias("last_shipped_seq"),
        F.when(k % 3 == 0, F.repeat(k.cast("string"), F.lit(40))).alias("shipper_version"))


HEARTBEATS = """
pings AS (
  SELECT '00000000-0000-4000-8000-' || lpad(install_id, 12, '0') AS install_id, ts,
    CASE WHEN k % 2 = 0 THEN event_id END AS seq,
    CASE WHEN k % 3 = 0 THEN substr(repeat(CAST(k AS VARCHAR), 40), 1, 64) END AS version
  FROM feed),
latest AS (
  SELECT install_id, epoch_us(max(ts)) // 1000 AS last_seen_ms, max(ts) AS last_seen,
    arg_max(seq, ts) FILTER (WHERE seq IS NOT NULL) AS last_shipped_seq,
    arg_max(version, ts) FILTER (WHERE version IS NOT NULL) AS shipper_version
  FROM pings GROUP BY ALL)"""


@query("heartbeat_latest", sql(FEED, HEARTBEATS, body="""
SELECT install_id, last_seen_ms, last_shipped_seq, shipper_version FROM latest"""))
def _(t):
    return ingest.latest_heartbeats(_pings(t)).select(
        "install_id", F.unix_millis("last_seen_at").alias("last_seen_ms"), "last_shipped_seq",
        "shipper_version")


@query("shipper_freshness", sql(FEED, HEARTBEATS, body=f"""
SELECT install_id, CAST(round(({AS_OF_US} - epoch_us(last_seen)) / 6e7) AS BIGINT) AS minutes_since,
  round(({AS_OF_US} - epoch_us(last_seen)) / 6e7) > 120 AS stale
FROM latest"""))
def _(t):
    return explorer.shipper_freshness(ingest.latest_heartbeats(_pings(t)), F.lit(AS_OF)).select(
        "install_id", "minutes_since", "stale")


@query("freshness_report", sql(TELEMETRY, HEARTBEATS, body=f"""
SELECT count(*) AS shippers,
  count(*) FILTER (WHERE round(({AS_OF_US} - epoch_us(last_seen)) / 6e7) > 120) AS stale_shippers,
  (SELECT max(received_us) // 1000 FROM telemetry) AS newest_event_ms,
  bool_and(round(({AS_OF_US} - epoch_us(last_seen)) / 6e7) <= 120) AS ok,
  120 AS stale_after_minutes
FROM latest"""))
def _(t):
    report = explorer.freshness_report(ingest.latest_heartbeats(_pings(t)), t.unordered(),
                                       F.lit(AS_OF))
    return report.select("shippers", "stale_shippers",
                         F.unix_millis("newest_event_at").alias("newest_event_ms"), "ok",
                         "stale_after_minutes")


@query("event_export", sql(TELEMETRY, body="""
SELECT ts_us // 1000 AS ts, received_us // 1000 AS received_at, session_id, seq, type, env, mod_id
FROM telemetry WHERE type NOT IN ('Heartbeat', 'SpikeStarted')"""))
def _(t):
    return ingest.export_rows(t.telemetry()).select("ts", "received_at", "session_id", "seq",
                                                    "type", "env", "mod_id")


@query("event_export_summary", sql(TELEMETRY, body="""
SELECT type, count(*) AS events, count(DISTINCT session_id) AS sessions
FROM telemetry WHERE type NOT IN ('Heartbeat', 'SpikeStarted') GROUP BY ALL"""))
def _(t):
    return ingest.export_summary(t.unordered())


ATTRIBUTION = {"AreaEntered": "base", "ConfrontationAttempted": "casefile",
               "ConfrontationExited": "casefile", "SkillCheckResolved": "casefile"}


@query("retro_attribution", sql(TELEMETRY, body="""
SELECT was AS mod_before, type, count(*) AS events,
  CASE WHEN was <> 'unknown' THEN was WHEN type = 'AreaEntered' THEN 'base'
       WHEN type IN ('ConfrontationAttempted', 'ConfrontationExited', 'SkillCheckResolved')
         THEN 'casefile' ELSE was END AS mod_after
FROM (SELECT *, CASE WHEN mod_id = 'mod0' THEN 'unknown' ELSE mod_id END AS was FROM telemetry)
GROUP BY ALL"""))
def _(t):
    events = t.unordered().withColumn("mod_id", F.when(F.col("mod_id") == "mod0", "unknown")
                                      .otherwise(F.col("mod_id")))
    return ingest.attribution_preview(events, ATTRIBUTION)


@query("hot_key_parity", sql(TELEMETRY, body="""
SELECT count(*) AS events, count(suspect) AS suspect, count(topic) AS topic,
  count(reason) AS reason, count(passed) AS passed, 0 AS drifted
FROM telemetry"""))
def _(t):
    # promoted columns against the payload they come from
    events = t.with_payload(t.unordered())
    drift = F.lit(False)
    for key, kind in payload.PROMOTED.items():
        drift = drift | ~F.col(key).eqNullSafe(payload.typed(key, kind))
    return events.agg(F.count("*").alias("events"),
                      *[F.count(key).alias(key) for key in payload.PROMOTED],
                      F.count_if(drift).cast("int").alias("drifted"))


# ---- explorer ------------------------------------------------------------------------------------

SHOWN = ("event_id", "session_id", "seq", "type", "env")


def _page(t, **options):
    # the newest days of the stored events, not a view of the whole feed
    _, log = folded_store(t)
    return explorer.newest_page(log, **options).select(*SHOWN, F.unix_micros("ts").alias("ts_us"))


@query("event_page", sql(TELEMETRY, body="""
SELECT event_id, session_id, seq, type, env, ts_us FROM telemetry
ORDER BY ts DESC, session_id DESC, seq DESC LIMIT 51"""))
def _(t):
    return _page(t)


@query("event_page_next", sql(TELEMETRY, body="""
SELECT event_id, session_id, seq, type, env, ts_us FROM telemetry
ORDER BY ts DESC, session_id DESC, seq DESC LIMIT 51 OFFSET 50"""))
def _(t):
    first = _page(t).collect()  # one page, at most 201 rows
    return _page(t, cursor=explorer.next_cursor(first))


@query("event_page_filtered", sql(TELEMETRY, body="""
SELECT event_id, session_id, seq, type, env, ts_us FROM telemetry
WHERE type = 'ConfrontationAttempted' AND suspect = 's1' AND env = 'prod'
  AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'
ORDER BY ts DESC, session_id DESC, seq DESC LIMIT 201"""))
def _(t):
    return _page(t, size=500, filters={
        "type": "ConfrontationAttempted", "suspect": "s1", "env": "prod", "mod_id": "",
        "from": 1704412800000, "to": 1705708800000, "check_id": "ignored"})


@query("payload_preview", """
SELECT 'k=' || json_extract_string(props, '$.k') AS preview, count(*) AS events
FROM events GROUP BY ALL""")
def _(t):
    return t.raw("events").groupBy(payload.preview("props").alias("preview")).agg(
        F.count("*").alias("events"))


@query("payload_shapes", """
SELECT 'k=' || k || ' · list=[' || CAST(k % 4 AS VARCHAR) || '] · none=∅ · obj={…}' AS preview, count(*) AS events
FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY ALL""")
def _(t):
    k = F.get_json_object("props", "$.k")
    items = F.array_join(F.array_repeat(F.lit("7"), (k.cast("int") % 4)), ",")
    data = F.concat(F.lit('{"k":'), k, F.lit(',"list":['), items, F.lit('],"none":null,"obj":{"a":1}}'))
    return t.raw("events").select(data.alias("data")).groupBy(payload.preview("data").alias("preview")).agg(
        F.count("*").alias("events"))


# ---- flow ----------------------------------------------------------------------------------------

@query("daily_counts", sql(TELEMETRY, body="""
SELECT strftime(ts, '%Y-%m-%d') AS day, type, count(*) AS events FROM telemetry GROUP BY ALL"""))
def _(t):
    return flow.daily_counts(t.unordered())


@query("sequence_gaps", sql(TELEMETRY, body=""",
arrived AS (
  SELECT session_id, lead(seq) OVER (PARTITION BY session_id ORDER BY seq) - seq - 1 AS lost
  FROM telemetry WHERE type <> 'Heartbeat')
SELECT session_id, count(*) AS events, CAST(coalesce(sum(lost), 0) AS BIGINT) AS missing,
  count(*) FILTER (WHERE lost > 0) AS gaps
FROM arrived GROUP BY ALL"""))
def _(t):
    # pings are left out, so each one shows as a hole in the sequence
    return flow.sequence_gaps(t.telemetry().filter(F.col("type") != "Heartbeat"))


@query("event_lateness", sql(TELEMETRY, body=""",
late AS (SELECT env, strftime(ts, '%Y-%m-%d %H') AS hour,
           CAST(round((received_us - ts_us) / 1e6) AS BIGINT) AS late FROM telemetry)
SELECT env, hour, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY late) AS p50,
  percentile_disc(0.9) WITHIN GROUP (ORDER BY late) AS p90, max(late) AS max
FROM late GROUP BY ALL"""))
def _(t):
    return flow.lateness(t.unordered())


@query("drop_off", sql(TELEMETRY, body=""",
ends AS (
  SELECT session_id, arg_max(type, seq) AS last_type,
    arg_max(area, seq) FILTER (WHERE area IS NOT NULL) AS last_area
  FROM telemetry WHERE type <> 'Heartbeat' GROUP BY ALL)
SELECT last_type, last_area, count(*) AS sessions FROM ends GROUP BY ALL"""))
def _(t):
    return flow.drop_off(t.telemetry())


@query("area_revisits", sql(TELEMETRY, body=""",
entered AS (
  SELECT area, row_number() OVER (PARTITION BY session_id, area ORDER BY seq) AS no,
    lead(ts_us) OVER (PARTITION BY session_id ORDER BY seq) - ts_us AS dwell
  FROM telemetry WHERE type = 'AreaEntered')
SELECT area, count(*) AS visits, count(*) FILTER (WHERE no > 1) AS revisits,
  round(sum(dwell) / 1e6 / nullif(count(dwell), 0), 1) AS avg_dwell_seconds
FROM entered GROUP BY ALL"""))
def _(t):
    return flow.area_revisits(t.telemetry())


@query("install_returns", sql(TELEMETRY, body=""",
bounds AS (
  SELECT install_id, session_id, min(ts_us) AS a, max(ts_us) AS b FROM telemetry GROUP BY ALL),
gaps AS (
  SELECT install_id, lead(a) OVER (PARTITION BY install_id ORDER BY a, session_id) - b AS gap
  FROM bounds)
SELECT install_id, count(*) AS sessions, round(CAST(sum(gap) AS DOUBLE) / 3.6e9, 3)
    AS total_break_hours, round(max(gap) / 3.6e9, 3) AS longest_break_hours
FROM gaps GROUP BY ALL"""))
def _(t):
    return flow.returns(t.unordered())


@query("milestone_funnel", sql(TELEMETRY, body=""",
firsts AS (
  SELECT install_id, min(ts_us) FILTER (WHERE type = 'AreaEntered') AS a,
    min(ts_us) FILTER (WHERE type = 'ConfrontationTopicEntered') AS b,
    min(ts_us) FILTER (WHERE type = 'ConfrontationAttempted') AS c,
    min(ts_us) FILTER (WHERE type = 'ConfrontationAttempted' AND passed) AS d
  FROM telemetry GROUP BY ALL)
SELECT 1 AS step_no, 'arrived' AS step, count(*) AS installs,
  CAST(NULL AS DOUBLE) AS avg_seconds_from_previous FROM firsts WHERE a IS NOT NULL
UNION ALL SELECT 2, 'topic', count(*), round(avg(b - a) / 1e6, 1) FROM firsts WHERE b >= a
UNION ALL SELECT 3, 'attempt', count(*), round(avg(c - b) / 1e6, 1) FROM firsts
  WHERE b >= a AND c >= b
UNION ALL SELECT 4, 'success', count(*), round(avg(d - c) / 1e6, 1) FROM firsts
  WHERE b >= a AND c >= b AND d >= c"""))
def _(t):
    kind = F.col("type")
    tried = kind == "ConfrontationAttempted"
    return flow.funnel(t.unordered(), {
        "arrived": kind == "AreaEntered", "topic": kind == "ConfrontationTopicEntered",
        "attempt": tried, "success": tried & F.col("passed")})


@query("engaged_of_exposed", sql(TELEMETRY, body=""",
pairs AS (
  SELECT install_id, suspect, topic, bool_or(type = 'ConfrontationAttempted') AS engaged,
    bool_or(type = 'ConfrontationTopicEntered' AND kind IN ('fact', 'pattern')) AS exposed
  FROM telemetry WHERE type IN ('ConfrontationAttempted', 'ConfrontationTopicEntered')
  GROUP BY ALL)
SELECT suspect, topic, count(*) AS exposed, count(*) FILTER (WHERE engaged) AS engaged,
  round(avg(CAST(engaged AS INT)), 3) AS engaged_share
FROM pairs WHERE exposed GROUP BY ALL"""))
def _(t):
    return flow.engagement(t.unordered())


@query("route_share", sql(TELEMETRY, body=""",
counts AS (
  SELECT check_id, skill_route AS route, count(*) AS passes FROM telemetry
  WHERE type = 'SkillCheckResolved' AND threshold_passed AND skill_route IS NOT NULL GROUP BY ALL)
SELECT *, round(passes / sum(passes) OVER (PARTITION BY check_id), 3) AS share FROM counts"""))
def _(t):
    used = t.unordered().filter((F.col("type") == "SkillCheckResolved") & F.col("threshold_passed")
                                & F.col("skill_route").isNotNull())
    return flow.share_within(used.withColumn("route", F.col("skill_route")),
                             ["check_id", "route"], "passes", ["check_id"])


@query("solution_share", sql(TELEMETRY, body=""",
counts AS (
  SELECT check_id, stat, count(*) AS passes FROM telemetry
  WHERE type = 'SkillCheckResolved' AND threshold_passed GROUP BY ALL)
SELECT *, round(passes / sum(passes) OVER (PARTITION BY check_id), 3) AS share,
  count(*) OVER (PARTITION BY check_id) AS routes
FROM counts QUALIFY routes > 1"""))
def _(t):
    return flow.solution_share(t.unordered())


@query("completion_by_route", sql(TELEMETRY, body=""",
used AS (
  SELECT DISTINCT session_id, skill_route AS route FROM telemetry
  WHERE type = 'SkillCheckResolved' AND threshold_passed AND skill_route IS NOT NULL),
done AS (
  SELECT session_id, coalesce(bool_or(type = 'ConfrontationExited' AND completed), false) AS c
  FROM telemetry GROUP BY ALL)
SELECT route, count(*) AS sessions, count(*) FILTER (WHERE c) AS completed_sessions,
  round(avg(CAST(c AS INT)), 3) AS completion_rate
FROM used JOIN done USING (session_id) GROUP BY ALL"""))
def _(t):
    return flow.completion_by_route(t.unordered())


# ---- exploration ---------------------------------------------------------------------------------

@query("evidence_possession", sql(EXPLORATION, body=""",
found AS (
  SELECT install_id, evidence_id, min(ts_us) AS found_us FROM exploration
  WHERE type = 'EvidenceCollected' GROUP BY ALL),
need AS (
  SELECT DISTINCT install_id, session_id, seq, suspect, topic, ts_us, unnest(evidence_ids) AS ev
  FROM exploration WHERE type = 'ConfrontationAttempted' AND NOT passed),
held AS (
  SELECT session_id, seq, suspect, topic, bool_and(coalesce(found_us < ts_us, false)) AS had_all
  FROM need LEFT JOIN found ON found.install_id = need.install_id AND evidence_id = ev
  GROUP BY ALL)
SELECT suspect, topic, CASE WHEN had_all THEN 'reasoning' ELSE 'discovery' END AS problem,
  count(*) AS failed_attempts
FROM held GROUP BY ALL"""))
def _(t):
    return flow.evidence_possession(t.exploration())


@query("declined_checks", sql(EXPLORATION, body=""",
seen AS (
  SELECT *, lead(type) OVER (PARTITION BY session_id, check_id ORDER BY seq) AS nxt
  FROM exploration WHERE type LIKE 'SkillCheck%'),
shown AS (
  SELECT *, coalesce(nxt <> 'SkillCheckResolved', true) AS declined,
    count(*) OVER (PARTITION BY session_id, display_group) AS group_size
  FROM seen WHERE type = 'SkillCheckDisplayed')
SELECT threshold_met, group_size, count(*) AS displayed,
  count(*) FILTER (WHERE declined) AS declined,
  round(avg(CAST(declined AS INT)), 3) AS declined_share
FROM shown GROUP BY ALL"""))
def _(t):
    return flow.declined_checks(t.exploration())


@query("boosted_passes", sql(EXPLORATION, body=""",
carried AS (
  SELECT *, last_value(item_id IGNORE NULLS) OVER (
    PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS last_item
  FROM exploration WHERE type IN ('ItemConsumed', 'SkillCheckResolved'))
SELECT last_item, count(*) AS passes, count(*) FILTER (WHERE base_value < threshold)
    AS boosted_passes, round(avg(CAST(base_value < threshold AS INT)), 3) AS boosted_share
FROM carried WHERE type = 'SkillCheckResolved' AND skill_value >= threshold GROUP BY ALL"""))
def _(t):
    return flow.boosted_passes(t.exploration())


@query("puzzle_attempts", sql(FEED, body=""",
tries AS (
  SELECT session_id, 'pz' || CAST(k % 5 AS VARCHAR) AS puzzle_id, value < 25 AS passed,
    row_number() OVER (PARTITION BY session_id, k % 5 ORDER BY ts, event_id) AS no
  FROM stream WHERE event_type = 'click' AND k % 25 <> 24),
per_session AS (
  SELECT session_id, puzzle_id, count(*) AS n, min(no) FILTER (WHERE passed) AS won
  FROM tries GROUP BY ALL)
SELECT puzzle_id, count(*) AS sessions, count(won) AS solved_sessions,
  CAST(sum(n) AS BIGINT) AS total_attempts, round(avg(won), 2) AS avg_attempts_to_pass
FROM per_session GROUP BY ALL"""))
def _(t):
    per_session = sequence.session_attempts(t.puzzles(), ("puzzle_id",))
    return per_session.groupBy("puzzle_id").agg(
        F.count("*").alias("sessions"), F.count("attempts_to_pass").alias("solved_sessions"),
        F.sum("total_attempts").alias("total_attempts"),
        F.round(F.avg("attempts_to_pass"), 2).alias("avg_attempts_to_pass"))


@query("undiscovered_content", sql(EXPLORATION, CONTENT, body=""",
seen AS (SELECT item_id, count(*) AS n FROM exploration WHERE type = 'ItemConsumed' GROUP BY ALL)
SELECT lower(record_id) AS item_id, coalesce(n, 0) AS seen
FROM records LEFT JOIN seen ON item_id = lower(record_id) WHERE type IN ('ALCH', 'INGR')"""))
def _(t):
    manifest = t.records().filter(F.col("type").isin("ALCH", "INGR")).select(
        F.lower("record_id").alias("item_id"))
    seen = (t.exploration(hot_rows=None).filter(F.col("type") == "ItemConsumed").groupBy("item_id")
            .agg(F.count("*").alias("seen")))
    return flow.discovery(manifest, seen, "item_id")


@query("consumed_item_effects", sql(EXPLORATION, CONTENT, body=""",
eaten AS (SELECT item_id, count(*) AS consumed FROM exploration
          WHERE type = 'ItemConsumed' GROUP BY ALL)
SELECT item_id, r.record_id, type, consumed, ordinal, effect_name, affected, affected_kind,
  magnitude_min, magnitude_max
FROM eaten JOIN records r ON lower(r.record_id) = item_id
JOIN effects e ON e.record_id = r.record_id"""))
def _(t):
    return flow.consumed_effects(t.exploration(hot_rows=None), t.records(), t.effects())


@query("area_content", sql(TELEMETRY, CONTENT, body=""",
visits AS (SELECT area, count(*) AS visits FROM telemetry WHERE type = 'AreaEntered' GROUP BY ALL),
content AS (SELECT area, count(*) AS items, CAST(sum(count) AS BIGINT) AS objects
            FROM placements GROUP BY ALL)
SELECT * FROM visits JOIN content USING (area)"""))
def _(t):
    return flow.area_content(t.unordered(), placement_tally(t.sightings()))
