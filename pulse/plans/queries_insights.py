"""Registered queries: evidence, bulk checks of candidate texts, review states."""

from pyspark.sql import functions as F

from pulse.operators import fuse, insights, lexical, sufficiency, vector
from pulse.operators.sufficiency import GATE
from pulse.plans.catalog import query
from pulse.plans.queries_search import FUSED
from pulse.plans.queries_stats import REMEDIES, SUFFICIENCY, gate_sufficiency, gates_sql
from pulse.plans.twin import CONTENT, LEXICAL, TELEMETRY, nearest_sql, sql
from pulse.session import stored

GATES = (TELEMETRY, CONTENT, gates_sql(), REMEDIES, SUFFICIENCY)

TOP = """
top AS (
  SELECT g.check_id, g.stat, g.stat_kind, g.threshold, r.record_id, r.name, r.type,
    r.magnitude_min, r.magnitude_max,
    row_number() OVER (PARTITION BY g.check_id, g.stat, g.stat_kind, g.threshold
                       ORDER BY r.magnitude_max DESC, r.record_id, r.ordinal) AS rank
  FROM gates g JOIN remedies r ON r.affected = g.stat AND r.affected_kind = g.stat_kind
    AND r.magnitude_max >= g.gap_p90
  QUALIFY rank <= 6)"""

KEY_SQL = "check_id || '/' || stat || '/' || stat_kind || '/' || CAST(threshold AS VARCHAR)"


def narrative(t):
    """Narrative records as one-chunk search corpus; `vec_id` = part number gives the vectors."""
    vectors = t.raw("embeddings").select(
        F.concat(F.lit("Part_"), F.col("vec_id").cast("string")).alias("record_id"), "embedding")
    told = t.records().filter(F.col("type").isin(*insights.NARRATIVE_TYPES))
    return told.join(vectors, "record_id", "left").select(
        F.concat("record_id", F.lit("#0")).alias("chunk_id"), "record_id", "type", "name",
        "source", F.col("full_text").alias("text"), F.sha2("full_text", 256).alias("text_hash"),
        "embedding")


_index: dict = {}


def narrative_index(t):
    """Terms of the narrative's chunks and their counts, written once for each session and state of the table."""
    key = (t.spark.sparkContext.applicationId, t.folder, t.stamp("part"))
    if key not in _index:
        index = stored(lexical.chunk_terms(narrative(t).drop("embedding")), "narrative-index")
        _index[key] = index, stored(lexical.term_counts(index), "narrative-terms")
    return _index[key]


def search(t, queries, query_vectors):
    """Hybrid search of the narrative records; CANDIDATE_PASSAGES hits a query."""
    chunks = narrative(t)
    words = stored(lexical.parse_queries(queries), "query-words")
    index, counts = narrative_index(t)
    near = vector.nearest(chunks, query_vectors, lexical.CANDIDATES)
    return fuse.hits(fuse.fuse(lexical.search(index, words, counts=counts, keep=stored), near), chunks.drop("embedding"),
                     insights.CANDIDATE_PASSAGES)


def gates_and_remedies(t):
    """Gates and their strongest remedies, both small, computed once for all that follows."""
    gates = stored(gate_sufficiency(t), "gates")
    rows = sufficiency.remedies(t.effects(), t.records(),
                                sufficiency.placement_tally(t.sightings()))
    return gates, stored(sufficiency.top_remedies(gates, rows), "top")


def evidence(t):
    gates, top = gates_and_remedies(t)
    keys = gates.withColumn("query_id", insights.gate_id())
    stats = gates.select("stat").distinct()
    # both kinds of query run as one search; their ids tell them apart
    asked = stats.select(F.col("stat").alias("query_id"),
                         insights.situation_text(F.col("stat")).alias("text")).unionByName(
                             insights.name_queries(top))
    # the given vectors stand for an embedder: a stat asks with the vector of its number, a gate's
    # names with that of its strongest remedy
    known = t.raw("embeddings").select(F.col("vec_id").cast("string").alias("n"),
                                       F.col("embedding").alias("vector"))
    asks = stats.select(F.col("stat").alias("query_id"), F.substring("stat", 3, 20).alias("n")).unionByName(
        top.filter("rank = 1").select(insights.gate_id().alias("query_id"), F.substring("record_id", 6, 20).alias("n")))
    vectors = known.join(asks, "n").select("query_id", "vector")
    found = stored(search(t, asked, vectors), "hits")  # bounded: forty per query
    situational = keys.select("query_id", "stat").join(
        found.withColumnRenamed("query_id", "stat"), "stat").drop("stat")
    by_name = found.join(keys.select("query_id"), "query_id", "left_semi")
    banned = top.withColumn("query_id", insights.gate_id())

    def kept(hits):
        return insights.rank_again(fuse.without_records(hits, banned)).select(
            "query_id", "rank", "record_id", "name", "snippet")

    passages = fuse.interleave(kept(by_name), kept(situational))
    return insights.assemble(gates, top, passages)


EVIDENCE = (TOP, f"""
passages AS (
  SELECT record_id || '#0' AS chunk_id, record_id, type, name, source, full_text AS text,
    sha256(full_text) AS text_hash FROM records
  WHERE type IN ('INFO', 'BOOK')),
query_texts AS (
  SELECT DISTINCT stat AS query_id, 'how can I improve my ' || stat ||
    ', or get help passing a difficult ' || stat || ' check' AS text
  FROM gates
  UNION ALL
  SELECT {KEY_SQL}, string_agg(name, ' ' ORDER BY rank) FROM top GROUP BY 1),
vectors AS (
  SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings JOIN passages ON record_id = 'Part_' || CAST(vec_id AS VARCHAR)),
query_vectors AS (
  SELECT query_id, CAST(embedding AS DOUBLE[]) AS q FROM (
    SELECT DISTINCT stat AS query_id, substr(stat, 3) AS n FROM gates
    UNION ALL SELECT {KEY_SQL}, substr(record_id, 6) FROM top WHERE rank = 1)
  JOIN embeddings ON CAST(vec_id AS VARCHAR) = n)""", LEXICAL, nearest_sql(100),
            FUSED.replace("rank <= 10", "rank <= 40"), f"""
found AS (SELECT query_id, record_id, rank FROM hits),
keys AS (SELECT {KEY_SQL} AS gate, * FROM classified),
lists AS (
  SELECT gate, 0 AS list_no, record_id, rank FROM keys JOIN found ON query_id = gate
  UNION ALL SELECT gate, 1, record_id, rank FROM keys JOIN found ON query_id = stat),
allowed AS (
  SELECT l.gate, list_no, l.record_id,
    row_number() OVER (PARTITION BY l.gate, list_no ORDER BY l.rank) AS turn
  FROM lists l WHERE NOT EXISTS (
    SELECT 1 FROM top WHERE {KEY_SQL} = l.gate AND lower(top.record_id) = lower(l.record_id))),
once AS (
  SELECT *, row_number() OVER (PARTITION BY gate, record_id ORDER BY turn, list_no) AS n
  FROM allowed),
placed AS (
  SELECT gate, record_id, row_number() OVER (PARTITION BY gate ORDER BY turn, list_no) AS place
  FROM once WHERE n = 1 QUALIFY place <= 8),
told AS (SELECT gate, string_agg(record_id, ',' ORDER BY place) AS passages FROM placed GROUP BY 1)""")


@query("evidence_assembly", sql(*GATES, *EVIDENCE, f"""
named AS (SELECT {KEY_SQL} AS gate, string_agg(record_id, ',' ORDER BY rank) AS remedies
          FROM top GROUP BY 1)""", body="""
SELECT check_id, stat, stat_kind, threshold, fails, gap_p90, verdict,
  coalesce(remedies, '') AS remedies, coalesce(passages, '') AS passages,
  CASE WHEN passages IS NULL THEN 'no_evidence' ELSE 'ready' END AS status
FROM keys LEFT JOIN told USING (gate) LEFT JOIN named USING (gate)"""))
def _(t):
    def ids(column):
        return F.array_join(F.transform(column, lambda r: r["record_id"]), ",").alias(column)

    return evidence(t).select(*GATE, "fails", "gap_p90", "verdict", ids("remedies"),
                              ids("passages"), "status")


def candidates(evidence_rows):
    """A drafted text per gate; some invent a number, cite a stranger, promise goods or are blank."""
    fails = F.col("fails") + F.when(F.col("threshold") == 100, 100000).otherwise(0)
    strongest = F.upper(F.try_element_at("remedies", F.lit(1))["record_id"])
    return evidence_rows.select(
        *GATE, F.format_string("Gate %s at %d", "check_id", "threshold").alias("headline"),
        F.format_string("Players fall short by %d in %d tries", "gap_p90", fails)
        .alias("rationale"),
        F.when(F.col("stat") == "st2", "Let a Merchant sell one")
        .when(F.col("stat") == "st3", "  ").otherwise("Lower the bar").alias("recommendation"),
        F.lit("UNCLEAR").alias("signposting"),
        F.array_compact(F.array(strongest, F.when(F.col("stat_kind") == "skill", "Part_x")))
        .alias("citations"))


@query("insight_checks", sql(*GATES, body="""
SELECT check_id, stat, stat_kind, threshold,
  CASE WHEN stat = 'st3' THEN 1 ELSE 0 END AS empty_field,
  CASE WHEN threshold = 100 THEN 1 ELSE 0 END AS unknown_number,
  CASE WHEN stat_kind = 'skill' THEN 1 ELSE 0 END AS uncited_record,
  CASE WHEN stat = 'st2' THEN 2 ELSE 0 END AS reachability_claim
FROM classified"""))
def _(t):
    rows = evidence(t)
    checked = insights.check(candidates(rows), rows)
    rules = ("empty_field", "unknown_number", "uncited_record", "reachability_claim")

    def count(rule):
        return F.size(F.filter("violations", lambda v: v["rule"] == rule)).alias(rule)

    return checked.select(*GATE, *[count(rule) for rule in rules])


@query("pending_insights", sql(*GATES, body="""
SELECT check_id, stat, stat_kind, threshold, 'Lower the bar' AS recommendation, 3 AS prompt_version,
  'pending' AS status
FROM classified WHERE stat NOT IN ('st2', 'st3') AND stat_kind <> 'skill' AND threshold <> 100"""))
def _(t):
    rows = evidence(t)
    stored = insights.accept(insights.check(candidates(rows), rows),
                             F.lit("2024-01-31").cast("timestamp"), 3, "external")
    return stored.select(*GATE, "recommendation", "prompt_version", "status")


@query("requested_gates", sql(*GATES, *EVIDENCE, body="""
, asked AS (
  SELECT DISTINCT check_id, stat, stat_kind, threshold FROM telemetry
  WHERE type = 'SkillCheckResolved')
SELECT check_id, stat, stat_kind, threshold,
  CASE WHEN fails IS NULL THEN 'no_gate' WHEN passages IS NULL THEN 'no_evidence'
       ELSE 'ready' END AS status
FROM asked LEFT JOIN keys USING (check_id, stat, stat_kind, threshold) LEFT JOIN told USING (gate)"""))
def _(t):
    # every check ever resolved asks for evidence; those nobody failed have no gate
    asked = t.unordered().filter(F.col("type") == "SkillCheckResolved").select(*GATE)
    return insights.requested_status(asked, evidence(t))


@query("matched_gates", sql(*GATES, body="""
, asked AS (
  SELECT DISTINCT check_id, stat, stat_kind, threshold FROM telemetry
  WHERE type = 'SkillCheckResolved' AND env = 'dev')
SELECT check_id, stat, stat_kind, threshold, fails, gap_p50, gap_p90
FROM gates JOIN asked USING (check_id, stat, stat_kind, threshold)"""))
def _(t):
    asked = t.unordered().filter((F.col("type") == "SkillCheckResolved")
                                 & (F.col("env") == "dev"))
    return sufficiency.match_gate(sufficiency.gate_gaps(t.unordered()), asked)


# ---- review --------------------------------------------------------------------------------------

STORED = """
stored AS (
  SELECT doc_id AS id, 'chk_' || CAST(doc_id % 8 AS VARCHAR) AS check_id,
    'st' || CAST(doc_id % 5 AS VARCHAR) AS stat,
    CASE WHEN doc_id % 2 = 0 THEN 'skill' ELSE 'attribute' END AS stat_kind,
    [25, 30, 40, 50, 60, 75, 100][(doc_id % 7) + 1] AS threshold, n_chars % 4 AS prompt_version,
    doc_id AS created_at FROM documents),
decided AS (
  SELECT id, check_id, stat, stat_kind, threshold, prompt_version, created_at,
    CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END
      AS status
  FROM stored LEFT JOIN labels l ON l.doc_id = id)"""


def all_insights(t):
    """One pending insight per document."""
    d = F.col("doc_id")
    bars = F.array(*[F.lit(b) for b in (25, 30, 40, 50, 60, 75, 100)])
    return t.raw("documents").select(
        d.alias("id"), F.concat(F.lit("chk_"), (d % 8).cast("string")).alias("check_id"),
        F.concat(F.lit("st"), (d % 5).cast("string")).alias("stat"),
        F.when(d % 2 == 0, "skill").otherwise("attribute").alias("stat_kind"),
        F.element_at(bars, (d % 7 + 1).cast("int")).alias("threshold"),
        (F.col("n_chars") % 4).alias("prompt_version"), d.alias("created_at"),
        F.lit("{}").alias("evidence"), F.lit("pending").alias("status"))


def decided(t):
    """Quality labels decide first; the toxic label comes later and must change nothing."""
    labels = t.raw("labels")
    first = labels.select(F.col("doc_id").alias("id"), F.lit(1).alias("decided_at"), F.when(
        F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"))
    second = labels.select(F.col("doc_id").alias("id"), F.lit(2).alias("decided_at"), F.when(
        F.col("toxic") == 1, "rejected").otherwise("approved").alias("decision"))
    return insights.review(all_insights(t), first.unionByName(second))


COLUMNS = ("id", "check_id", "stat", "stat_kind", "threshold", "status")


@query("review_states", sql(STORED, body="""
SELECT id, check_id, stat, stat_kind, threshold, status FROM decided"""))
def _(t):
    return decided(t).select(*COLUMNS)


@query("published_insights", sql(STORED, body="""
SELECT id, check_id, stat, stat_kind, threshold, status FROM decided WHERE status = 'approved'
ORDER BY created_at DESC, id DESC LIMIT 50"""))
def _(t):
    return insights.published(decided(t)).select(*COLUMNS)


@query("published_for_check", sql(STORED, body="""
SELECT id, check_id, stat, stat_kind, threshold, status FROM decided
WHERE status = 'approved' AND check_id = 'chk_3' ORDER BY created_at DESC, id DESC LIMIT 50"""))
def _(t):
    return insights.published(decided(t), "chk_3").select(*COLUMNS)


@query("review_queue", sql(STORED, body="""
SELECT id, check_id, stat, stat_kind, threshold, status FROM decided WHERE status = 'pending'
ORDER BY created_at, id LIMIT 50"""))
def _(t):
    return insights.review_queue(decided(t)).select(*COLUMNS)


@query("prompt_drift", sql(STORED, body="""
SELECT prompt_version, count(*) AS insights FROM decided WHERE prompt_version < 3 GROUP BY ALL"""))
def _(t):
    return insights.drifted(decided(t), 3).groupBy("prompt_version").agg(
        F.count("*").alias("insights"))


@query("gate_insights", sql(*GATES, STORED, body="""
SELECT check_id, stat, stat_kind, threshold, fails, max(id) AS insight_id
FROM classified LEFT JOIN (SELECT * FROM decided WHERE status = 'approved') a
  USING (check_id, stat, stat_kind, threshold)
GROUP BY check_id, stat, stat_kind, threshold, fails"""))
def _(t):
    return insights.with_insight(gate_sufficiency(t).select(*GATE, "fails"), decided(t))
