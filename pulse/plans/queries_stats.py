"""Registered queries: grouped statistics, sequences and gate sufficiency."""

from pyspark.sql import functions as F

from pulse.functions import payload
from pulse.functions.scope import SCOPES, env_note, env_predicate
from pulse.operators import sequence, stats, sufficiency
from pulse.plans.catalog import query
from pulse.plans.twin import CONTENT, TELEMETRY, sql
from pulse.session import scratch_path
from pulse.sources import ingest

TRIED = "type = 'ConfrontationAttempted'"
BY_TOPIC = f"""
topics AS (
  SELECT suspect, topic, count(*) AS attempts, count(*) FILTER (WHERE passed) AS passes
  FROM telemetry WHERE {TRIED} GROUP BY ALL)"""

NEXT = """
paired AS (
  SELECT *, lead(type) OVER w AS n_type, lead(suspect) OVER w AS n_suspect,
         lead(topic) OVER w AS n_topic, lead(completed) OVER w AS n_completed,
         lead(ts_us) OVER w - ts_us AS gap_us
  FROM telemetry WHERE type NOT IN ('Heartbeat', 'SpikeStarted')
  WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
fails AS (
  SELECT *, CASE WHEN n_type IS NULL THEN 'session_end'
      WHEN n_type = 'ConfrontationAttempted' AND n_suspect = suspect AND n_topic = topic
        THEN 'retried_same'
      WHEN n_type = 'ConfrontationExited' AND n_completed THEN 'exited_solved'
      WHEN n_type = 'ConfrontationExited' THEN 'abandoned'
      WHEN n_type = 'ConfrontationAttempted' THEN 'switched_topic'
      WHEN n_type = 'AreaEntered' THEN 'left_area' ELSE 'other' END AS next_action
  FROM paired WHERE type = 'ConfrontationAttempted' AND NOT passed)"""

AFTER = """
after_failure AS (
  SELECT suspect, topic, next_action, count(*) AS count,
         round(CAST(sum(gap_us) AS DOUBLE) / 1e6 / nullif(count(gap_us), 0), 1) AS avg_gap_seconds
  FROM fails GROUP BY ALL)"""

ATTEMPTS = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, suspect, topic ORDER BY seq) AS no
  FROM telemetry WHERE type = 'ConfrontationAttempted'),
per_session AS (
  SELECT session_id, install_id, suspect, topic, count(*) AS total_attempts,
         min(no) FILTER (WHERE passed) AS attempts_to_pass
  FROM numbered GROUP BY ALL)"""

TO_PASS = """
to_pass AS (
  SELECT suspect, topic, count(*) AS sessions, count(attempts_to_pass) AS solved_sessions,
         CAST(sum(total_attempts) AS BIGINT) AS total_attempts,
         round(avg(attempts_to_pass), 2) AS avg_attempts_to_pass,
         max(total_attempts) AS max_attempts_in_a_session
  FROM per_session GROUP BY ALL)"""

CHECKS = """
checks AS (
  SELECT *, skill_value - threshold AS margin FROM telemetry
  WHERE type = 'SkillCheckResolved' AND trigger = 'inspect'),
by_check AS (
  SELECT check_id, stat, stat_kind, count(*) AS attempts,
         count(*) FILTER (WHERE threshold_passed) AS passes,
         round(avg(CAST(threshold_passed AS INT)), 3) AS pass_rate,
         count(*) FILTER (WHERE passed AND NOT threshold_passed) AS fluke_passes,
         round(avg(margin) FILTER (WHERE NOT threshold_passed), 1) AS avg_fail_margin,
         max(margin) FILTER (WHERE NOT threshold_passed) AS closest_fail_margin,
         min(margin) FILTER (WHERE NOT threshold_passed) AS worst_fail_margin
  FROM checks GROUP BY ALL)"""


def gates_sql(scope: str = "env <> 'synthetic'") -> str:
    return f"""
gates AS (
  SELECT check_id, stat, stat_kind, threshold, count(*) AS fails,
         percentile_disc(0.5) WITHIN GROUP (ORDER BY threshold - skill_value) AS gap_p50,
         percentile_disc(0.9) WITHIN GROUP (ORDER BY threshold - skill_value) AS gap_p90
  FROM telemetry
  WHERE type = 'SkillCheckResolved' AND trigger = 'inspect' AND NOT passed AND {scope}
    AND threshold - skill_value > 0
  GROUP BY ALL)"""


REMEDIES = """
areas AS (SELECT item_record_id, count(*) AS areas FROM placements GROUP BY ALL),
remedies AS (
  SELECT e.*, r.type, r.name, coalesce(a.areas, 0) AS placed_areas
  FROM effects e JOIN records r ON r.record_id = e.record_id
  LEFT JOIN areas a ON a.item_record_id = lower(r.record_id)
  WHERE e.effect_name ILIKE 'fortify%' AND e.affected IS NOT NULL
    AND NOT (r.type = 'SPEL' AND e.duration = 0))"""

SUFFICIENCY = """
counted AS (
  SELECT g.check_id, g.stat, g.stat_kind, g.threshold, g.fails, g.gap_p50, g.gap_p90,
    count(r.affected) FILTER (WHERE r.magnitude_min >= g.gap_p90) AS reliable,
    count(r.affected) FILTER (WHERE r.magnitude_max >= g.gap_p90) AS possible,
    count(r.affected) FILTER (WHERE r.magnitude_min IS NULL) AS unknown_magnitude,
    count(r.affected) FILTER (WHERE r.magnitude_max >= g.gap_p90 AND r.placed_areas > 0)
      AS placed_remedies,
    CAST(coalesce(sum(r.placed_areas) FILTER (WHERE r.magnitude_max >= g.gap_p90), 0) AS BIGINT)
      AS placed_areas,
    count(r.affected) FILTER (WHERE r.magnitude_max >= g.gap_p90 AND r.type IN ('ALCH', 'INGR'))
      AS surveyable_possible
  FROM gates g LEFT JOIN remedies r ON r.affected = g.stat AND r.affected_kind = g.stat_kind
  GROUP BY ALL),
classified AS (
  SELECT *, CASE WHEN possible = 0 THEN 'no_remedy' WHEN reliable = 0 THEN 'gamble_only'
                 ELSE 'remedy_exists' END AS verdict,
    CASE WHEN surveyable_possible = 0 THEN 'UNKNOWN' WHEN placed_remedies > 0 THEN 'PLACED'
         ELSE 'NOT_PLACED' END AS reachable, true AS surveyed
  FROM counted)"""


# ---- confrontations ----------------------------------------------------------------------------

@query("confrontations_by_topic", sql(TELEMETRY, BY_TOPIC, body="""
SELECT *, round(CAST(passes AS DOUBLE) / attempts, 3) AS pass_rate FROM topics"""))
def _(t):
    return stats.by_topic(t.unordered())


@query("failure_reasons", sql(TELEMETRY, body=f"""
SELECT reason, count(*) AS count FROM telemetry WHERE {TRIED} AND NOT passed GROUP BY ALL"""))
def _(t):
    return stats.by_reason(t.unordered())


@query("overall_attempts", sql(TELEMETRY, body=f"""
SELECT count(*) AS attempts, count(*) FILTER (WHERE passed) AS passes,
       round(CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*), 3) AS pass_rate
FROM telemetry WHERE {TRIED}"""))
def _(t):
    return stats.overall(t.unordered())


RANKING = """
prior AS (SELECT CAST(sum(attempts - passes) AS DOUBLE) / sum(attempts) AS c FROM topics)
SELECT suspect, topic, attempts, attempts - passes AS fails,
  round(CAST(attempts - passes AS DOUBLE) / attempts, 4) AS raw_fail_rate,
  round((attempts - passes + 10 * c) / (attempts + 10), 4) AS shrunk_fail_rate,
  round(ln(attempts), 4) AS volume_weight,
  round((attempts - passes + 10 * c) / (attempts + 10) * ln(attempts), 4) AS stuck_score,
  round(c, 4) AS global_fail_rate, attempts < 20 AS low_confidence
FROM topics, prior"""


@query("stuck_ranking", sql(TELEMETRY, BY_TOPIC + ",", body=RANKING))
def _(t):
    return stats.in_ranking_order(stats.stuck_ranking(stats.by_topic(t.unordered())))


# ---- sequences -----------------------------------------------------------------------------------

@query("after_failure", sql(TELEMETRY, NEXT, AFTER, body=" SELECT * FROM after_failure"))
def _(t):
    return sequence.after_failure(sequence.after_failure_partials(t.telemetry()))


@query("after_failure_pivot", sql(TELEMETRY, NEXT, body="""
SELECT suspect, topic,
  count(*) FILTER (WHERE next_action = 'retried_same') AS retried_same,
  count(*) FILTER (WHERE next_action = 'exited_solved') AS exited_solved,
  count(*) FILTER (WHERE next_action = 'switched_topic') AS switched_topic,
  count(*) FILTER (WHERE next_action = 'abandoned') AS abandoned,
  count(*) FILTER (WHERE next_action = 'session_end') AS session_end,
  count(*) FILTER (WHERE next_action IN ('left_area', 'other')) AS other, count(*) AS total
FROM fails GROUP BY ALL"""))
def _(t):
    return sequence.after_failure_pivot(
        sequence.after_failure(sequence.after_failure_partials(t.telemetry())))


@query("attempts_to_pass", sql(TELEMETRY, ATTEMPTS, TO_PASS, body=" SELECT * FROM to_pass"))
def _(t):
    return sequence.attempts_to_pass(sequence.confrontation_attempts(t.telemetry()))


@query("session_attempts", sql(TELEMETRY, ATTEMPTS, body=" SELECT * FROM per_session"))
def _(t):
    return sequence.confrontation_attempts(t.telemetry())


@query("comeback", sql(TELEMETRY, ATTEMPTS, body=""",
per_install AS (
  SELECT install_id, suspect, topic, bool_or(attempts_to_pass IS NOT NULL) AS solved,
         bool_or(attempts_to_pass IS NULL) AS unsolved
  FROM per_session GROUP BY ALL)
SELECT suspect, topic, count(*) FILTER (WHERE solved AND unsolved) AS came_back_and_won,
  count(*) FILTER (WHERE unsolved AND NOT solved) AS never_solved_any_session,
  count(*) AS installs
FROM per_install GROUP BY ALL"""))
def _(t):
    return sequence.comeback(sequence.confrontation_attempts(t.telemetry()))


@query("unpassable_topics", sql(TELEMETRY, body=f""",
pairs AS (SELECT session_id, install_id, suspect, topic, count(*) AS total_attempts,
            count(*) FILTER (WHERE passed) AS wins FROM telemetry WHERE {TRIED} GROUP BY ALL)
SELECT install_id, suspect, topic, count(*) AS sessions,
  CAST(sum(total_attempts) AS BIGINT) AS total_attempts
FROM pairs GROUP BY ALL HAVING sum(wins) = 0 AND sum(total_attempts) >= 3"""))
def _(t):
    # per install, so that content no one player got past is listed too
    per_install = sequence.confrontation_attempts(t.telemetry()).groupBy(
        "install_id", "suspect", "topic").agg(
            F.count("*").alias("sessions"), F.count("attempts_to_pass").alias("solved_sessions"),
            F.sum("total_attempts").alias("total_attempts"))
    return sequence.unpassable(per_install, 3).drop("solved_sessions")


# ---- skill checks --------------------------------------------------------------------------------

@query("skill_by_check", sql(TELEMETRY, CHECKS, body=" SELECT * FROM by_check"))
def _(t):
    return stats.by_check(t.unordered())


@query("collapsed_checks", sql(TELEMETRY, CHECKS, body="""
SELECT check_id, 'Chk ' || split_part(check_id, '_', 2) AS label,
  closest_fail_margin AS margin, stat, stat_kind, attempts,
  count(*) OVER (PARTITION BY check_id) AS variants
FROM by_check WHERE closest_fail_margin IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY check_id
  ORDER BY closest_fail_margin DESC, attempts DESC, stat, stat_kind) = 1"""))
def _(t):
    return stats.collapse_checks(stats.by_check(t.unordered()))


@query("failure_distance", sql(TELEMETRY, CHECKS, body=""",
worst AS (
  SELECT session_id, check_id, max(margin) AS margin FROM checks GROUP BY ALL
  HAVING NOT bool_or(threshold_passed)),
banded AS (
  SELECT *, CASE WHEN margin >= -10 THEN 'near_miss' WHEN margin >= -15 THEN 'moderate_gap'
                 ELSE 'build_gap' END AS band FROM worst)
SELECT band, count(*) AS count, round(avg(margin), 1) AS avg_margin,
  CASE band WHEN 'near_miss' THEN 1 WHEN 'moderate_gap' THEN 2 ELSE 3 END AS band_rank
FROM banded GROUP BY band"""))
def _(t):
    return stats.failure_distance(t.unordered())


@query("stat_coverage", sql(TELEMETRY, body="""
SELECT stat, stat_kind, trigger, count(*) AS checks, count(DISTINCT check_id) AS distinct_checks,
  round(avg(CAST(threshold_passed AS INT)), 3) AS pass_rate
FROM telemetry WHERE type = 'SkillCheckResolved' GROUP BY ALL"""))
def _(t):
    return stats.stat_coverage(t.unordered())


@query("routes_taken", sql(TELEMETRY, body="""
SELECT skill_route AS route, count(*) AS passes FROM telemetry
WHERE type = 'SkillCheckResolved' AND skill_route IS NOT NULL AND threshold_passed GROUP BY ALL"""))
def _(t):
    events = t.with_payload(t.unordered())
    return stats.routes_taken(events, payload.has_key("skill_route"))


@query("typed_payload", sql(TELEMETRY, body="""
SELECT check_id, stat AS skill, CAST(sum(skill_value - threshold) AS BIGINT) AS margin_sum,
  count(*) FILTER (WHERE passed) AS passes, count(*) AS checks
FROM telemetry WHERE type = 'SkillCheckResolved' GROUP BY ALL"""))
def _(t):
    rows = t.with_payload(t.unordered()).filter(F.col("type") == "SkillCheckResolved").select(
        payload.text("check_id").alias("check_id"), payload.text("skill").alias("skill"),
        (payload.typed("skill_value", "int") - payload.typed("threshold", "int")).alias("margin"),
        payload.typed("passed", "boolean").alias("passed"))
    return rows.groupBy("check_id", "skill").agg(
        F.sum("margin").alias("margin_sum"), F.count_if("passed").alias("passes"),
        F.count("*").alias("checks"))


# ---- gates ---------------------------------------------------------------------------------------

@query("gate_gaps", sql(TELEMETRY, gates_sql(), body=" SELECT * FROM gates"))
def _(t):
    return sufficiency.gate_gaps(t.unordered())


@query("gate_sufficiency", sql(TELEMETRY, CONTENT, gates_sql(), REMEDIES, SUFFICIENCY,
                               body=" SELECT * FROM classified"))
def gate_sufficiency(t):
    placements = sufficiency.placement_tally(t.sightings())
    return sufficiency.sufficiency(t.unordered(), t.effects(), t.records(), placements,
                                   t.raw("nation"))


@query("gates_unsurveyed", sql(TELEMETRY, CONTENT, gates_sql(), REMEDIES, SUFFICIENCY, body="""
SELECT * REPLACE (false AS surveyed, 'UNKNOWN' AS reachable, 0 AS placed_remedies, 0 AS placed_areas)
FROM classified"""))
def _(t):
    # no survey was ever loaded: absence of a placement is then no finding
    placements = sufficiency.placement_tally(t.sightings())
    return sufficiency.sufficiency(t.unordered(), t.effects(), t.records(), placements,
                                   t.raw("nation").filter("n_nationkey IS NULL"))


@query("worst_gates", sql(TELEMETRY, CONTENT, gates_sql(), REMEDIES, SUFFICIENCY, body="""
SELECT * FROM classified ORDER BY fails DESC, check_id, stat, stat_kind, threshold LIMIT 25"""))
def _(t):
    return sufficiency.worst_gates(gate_sufficiency(t), 25)


@query("sufficiency_summary", sql(TELEMETRY, CONTENT, gates_sql(), REMEDIES, SUFFICIENCY, body=f"""
SELECT count(*) AS total_gates, count(*) FILTER (WHERE verdict = 'remedy_exists') AS remedy_exists,
  count(*) FILTER (WHERE verdict = 'gamble_only') AS gamble_only,
  count(*) FILTER (WHERE verdict = 'no_remedy') AS no_remedy, bool_or(surveyed) AS surveyed,
  '{sufficiency.SURVEYED_NOTE}' AS reachability_note, 'real' AS env_scope,
  '{env_note("real")}' AS env_note
FROM classified"""))
def _(t):
    return sufficiency.envelope(gate_sufficiency(t))


@query("top_remedies", sql(TELEMETRY, CONTENT, gates_sql(), REMEDIES, body="""
SELECT g.check_id, g.stat, g.stat_kind, g.threshold, g.gap_p90, r.record_id, r.name, r.type,
  r.magnitude_min, r.magnitude_max,
  row_number() OVER (PARTITION BY g.check_id, g.stat, g.stat_kind, g.threshold
                     ORDER BY r.magnitude_max DESC, r.record_id, r.ordinal) AS rank
FROM gates g JOIN remedies r ON r.affected = g.stat AND r.affected_kind = g.stat_kind
  AND r.magnitude_max >= g.gap_p90
QUALIFY rank <= 6"""))
def _(t):
    rows = sufficiency.remedies(t.effects(), t.records(),
                                sufficiency.placement_tally(t.sightings()))
    return sufficiency.top_remedies(sufficiency.gate_gaps(t.unordered()), rows)


@query("placement_tally", sql(CONTENT, body=" SELECT * FROM placements"))
def _(t):
    return sufficiency.placement_tally(t.sightings())


# ---- volume and scope ----------------------------------------------------------------------------

@query("env_scopes", sql(TELEMETRY, body=f""",
scopes AS (
  SELECT 'real' AS scope, '{env_note("real")}' AS env_note UNION ALL
  SELECT 'synthetic', '{env_note("synthetic")}' UNION ALL SELECT 'all', '{env_note("all")}')
SELECT scope, env_note, count(*) AS events FROM scopes JOIN telemetry
  ON scope = 'all' OR (scope = 'synthetic') = (env = 'synthetic') GROUP BY ALL"""))
def _(t):
    # all three scopes in one pass: filtered counts, then one row per scope
    counts = t.unordered().agg(*[F.count_if(env_predicate(s)).alias(s) for s in SCOPES])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(env_note(s))
                                        .alias("env_note"), F.col(s).alias("events"))
                               for s in SCOPES]))
    return counts.select(rows.alias("row")).select("row.*")


@query("counts_by_mod_type", sql(TELEMETRY, body="""
SELECT mod_id, type, count(*) AS events FROM telemetry GROUP BY ALL"""))
def _(t):
    return stats.counts_by(t.unordered(), "mod_id", "type")


@query("snapshot_export", sql(TELEMETRY, body="""
SELECT mod_id, type, count(*) AS events FROM telemetry GROUP BY ALL"""))
def _(t):
    # stored as a snapshot and read back
    path = scratch_path(t.spark, "snapshot")
    ingest.write_snapshot(stats.counts_by(t.unordered(), "mod_id", "type"), path,
                          F.lit("2024-01-31").cast("timestamp"))
    return t.spark.read.schema("mod_id string, type string, events long").json(path)


@query("counts_by_env", sql(TELEMETRY, body="""
SELECT env, count(*) AS events FROM telemetry GROUP BY ALL"""))
def _(t):
    return stats.counts_by(t.unordered(), "env")


@query("mods_list", sql(TELEMETRY, body="""
SELECT mod_id, min(received_us) // 1000 AS first_seen_ms, max(received_us) // 1000 AS last_seen_ms,
  count(*) AS events, count(DISTINCT session_id) AS sessions
FROM telemetry GROUP BY ALL"""))
def _(t):
    from pulse.sources.ingest import mod_registry
    events = t.unordered()
    mods = mod_registry(events).select(
        "mod_id", F.unix_millis("first_seen_at").alias("first_seen_ms"),
        F.unix_millis("last_seen_at").alias("last_seen_ms"))
    return stats.mods_list(events, mods)


@query("session_sizes", sql(TELEMETRY, body=""",
sizes AS (SELECT session_id, count(*) AS size FROM telemetry GROUP BY ALL)
SELECT 'all' AS scope, count(*) AS sessions,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY size) AS p50,
  percentile_disc(0.9) WITHIN GROUP (ORDER BY size) AS p90,
  percentile_disc(0.99) WITHIN GROUP (ORDER BY size) AS p99, max(size) AS max
FROM sizes"""))
def _(t):
    return stats.session_sizes(t.unordered())
