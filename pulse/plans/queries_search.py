"""Registered queries: lexical, vector and hybrid retrieval."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions import vectors
from pulse.operators import fuse, lexical, sketch, sufficiency, vector
from pulse.plans.catalog import query
from pulse.plans.queries_stats import REMEDIES, gates_sql
from pulse.plans.twin import (CONTENT, DOCS, HYBRID_TEXTS, LABEL_VECTORS, LEXICAL, PASSAGES, QUERY_TEXTS, TELEMETRY,
                              VECTORS, WEB_TEXTS, distance_sql, nearest_sql, sql)
from pulse.session import stored


_index: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def lexical_index(t) -> tuple[DataFrame, DataFrame]:
    """Terms of every chunk and counts of every term, written once for each session and state of the table."""
    key = (t.spark.sparkContext.applicationId, t.folder, t.stamp("documents"))
    if key not in _index:
        index = stored(lexical.chunk_terms(t.lines(), "record_id"), "lexical-index")
        _index[key] = index, stored(lexical.term_counts(index), "lexical-terms")
    return _index[key]


def best(t, queries):
    index, counts = lexical_index(t)
    return lexical.search(index, lexical.parse_queries(queries), counts=counts, keep=stored)


# ---- lexical -------------------------------------------------------------------------------------

@query("text_terms", sql(PASSAGES, QUERY_TEXTS, LEXICAL, body="""
SELECT term, count(*) AS occurrences, count(DISTINCT chunk_id) AS chunks
FROM positions GROUP BY ALL"""))
def _(t):
    return lexical_index(t)[1]


@query("query_words", sql(PASSAGES, WEB_TEXTS, LEXICAL, body="""
SELECT query_id, CAST(alt AS BIGINT) AS alt, clause, negative, "offset", term FROM query_words"""))
def _(t):
    return lexical.parse_queries(t.web_queries())


@query("lexical_search", sql(PASSAGES, QUERY_TEXTS, LEXICAL, body="""
SELECT query_id, chunk_id, score, lexical_rank FROM ranked_lexical"""))
def _(t):
    return best(t, t.benchmark_queries())


@query("phrase_search", sql(PASSAGES, WEB_TEXTS, LEXICAL, body="""
SELECT query_id, chunk_id, score, lexical_rank FROM ranked_lexical"""))
def _(t):
    return best(t, t.web_queries())


@query("record_rollup", sql(PASSAGES, WEB_TEXTS, LEXICAL, body="""
SELECT query_id, record_id, round(max(score), 6) AS best, round(avg(score), 6) AS mean
FROM scores JOIN passages USING (chunk_id) GROUP BY ALL"""))
def _(t):
    index, counts = lexical_index(t)
    return lexical.record_scores(index, lexical.parse_queries(t.web_queries()), counts)


# ---- vectors -------------------------------------------------------------------------------------

@query("knn_exact", sql(VECTORS, nearest_sql(10), body=" SELECT * FROM near"))
def knn_exact(t):
    return vector.nearest(t.vectors(), t.query_vectors(), 10)


@query("knn_blocks", sql(VECTORS, nearest_sql(10), body=" SELECT * FROM near"))
def _(t):
    # the same search cut into many small blocks on both sides
    return vector.nearest(t.vectors(), t.query_vectors(), 10, block=70, query_block=3)


@query("knn_filtered", sql(VECTORS, DOCS, nearest_sql(
    10, "chunk_id IN (SELECT record_id || '#0' FROM docs WHERE type IN ('BOOK', 'INFO'))"),
    body=" SELECT * FROM near"))
def _(t):
    narrative = t.documents().filter(F.col("type").isin("BOOK", "INFO"))
    chunks = t.vectors().join(narrative.select(F.concat("record_id", F.lit("#0"))
                                               .alias("chunk_id")), "chunk_id", "left_semi")
    return vector.nearest(chunks, t.query_vectors(), 10)


# Probes of the ten label cells with which the pruned search keeps a recall of 0.9.
REACH = 8

PRUNED = f"""
means AS (
  SELECT 'c' || CAST(label AS VARCHAR) AS cell, list(m ORDER BY i) AS c
  FROM (SELECT label, i, avg(v[i]) AS m FROM vectors, range(1, 65) AS r(i) GROUP BY label, i)
  GROUP BY label),
placed AS (
  SELECT chunk_id, v, cell FROM vectors, means
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY {distance_sql("v", "c")}, cell) = 1),
probed AS (
  SELECT query_id, q, cell FROM query_vectors, means
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {distance_sql("q", "c")}, cell) <= {REACH}),
pruned AS (
  SELECT query_id, chunk_id, {distance_sql("q", "v")} AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY {distance_sql("q", "v")}, chunk_id)
      AS vector_rank
  FROM probed JOIN placed USING (cell) QUALIFY vector_rank <= 10)"""


def label_means(t):
    """Cells of the pruned search: the mean vector of each label."""
    per_dim = t.vectors().select("label", F.posexplode("embedding").alias("i", "x")).groupBy(
        "label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return per_dim.groupBy("label").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector")).select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("query_id"), "vector")


@query("knn_pruned", sql(VECTORS, PRUNED, body=" SELECT * FROM pruned"))
def knn_pruned(t):
    return vector.nearest_pruned(t.vectors(), t.query_vectors(), label_means(t), 10, probes=REACH)


@query("recall_at_k", sql(VECTORS, nearest_sql(10), PRUNED, body="""
SELECT 10 AS k, (SELECT count(*) FROM near) AS expected, count(*) AS found,
  round(count(*) / (SELECT count(*) FROM near), 4) AS recall
FROM near JOIN pruned USING (query_id, chunk_id)"""))
def _(t):
    return vector.recall(knn_exact(t), knn_pruned(t), 10)


CELLS, PROBES = 8, (1, 2, 4, 8)


@query("recall_by_probes", sql(VECTORS, nearest_sql(10), body=f"""
SELECT probes, (SELECT count(*) FROM near) AS expected, true AS none_lost, true AS whole_when_all
FROM (VALUES {", ".join(f"({p})" for p in PROBES)}) AS v(probes)"""))
def _(t):
    # cells trained on the vectors; recall never falls with more probes and is whole with all
    truth, chunks = knn_exact(t), t.vectors()
    cells = stored(vector.train_centroids(chunks, CELLS), "centroids")
    rows = None
    for probes in PROBES:
        found = vector.nearest_pruned(chunks, t.query_vectors(), cells, 10, probes)
        row = vector.recall(truth, found, 10).withColumn("probes", F.lit(probes))
        rows = row if rows is None else rows.unionByName(row)
    # one row per number of probes
    before = F.lag("found", 1, 0).over(Window.orderBy("probes"))
    return rows.select("probes", "expected", (F.col("found") >= before).alias("none_lost"),
                       ((F.col("probes") < CELLS) | (F.col("found") == F.col("expected"))).alias("whole_when_all"))


@query("knn_all_queries", sql(VECTORS, nearest_sql(10), body=" SELECT * FROM near"))
def knn_all_queries(t):
    return knn_exact(t)


# Probes of the ten label cells: few, those of knn_pruned, and all.
ALL_PROBES = (3, REACH, 10)


@query("recall_all_queries", sql(VECTORS, nearest_sql(10), PRUNED, body=f""",
turns AS (
  SELECT query_id, cell, row_number() OVER (
    PARTITION BY query_id ORDER BY {distance_sql("q", "c")}, cell) AS turn FROM query_vectors, means)
SELECT probes, 10 AS k, (SELECT count(*) FROM near) AS expected, count(*) AS found,
  round(count(*) / (SELECT count(*) FROM near), 4) AS recall
FROM (VALUES {", ".join(f"({p})" for p in ALL_PROBES)}) AS p(probes), near
JOIN placed USING (chunk_id) JOIN turns USING (query_id, cell) WHERE turn <= probes GROUP BY probes"""))
def _(t):
    truth, cells, rows = knn_all_queries(t), label_means(t), None
    for probes in ALL_PROBES:
        found = vector.nearest_pruned(t.vectors(), t.query_vectors(), cells, 10, probes)
        row = vector.recall(truth, found, 10).withColumn("probes", F.lit(probes))
        rows = row if rows is None else rows.unionByName(row)
    return rows


# Codes of four bits a dimension lose none of the ten nearest at the tested sizes, so exact search checks it.
@query("knn_sketched", sql(VECTORS, nearest_sql(10), body=" SELECT * FROM near"))
def knn_sketched(t):
    return sketch.nearest(t.vectors(), t.query_vectors(), 10)


@query("recall_sketched", sql(VECTORS, nearest_sql(10), body=f"""
SELECT 10 AS k, count(*) AS expected, count(*) AS found, CAST(1 AS DOUBLE) AS recall,
  (SELECT round({sketch.SHORTLIST} / count(*), 4) FROM vectors) AS compared
FROM near"""))
def _(t):
    # share of the exact answer that the codes kept, and of all distances that were computed
    chunks = t.vectors().agg(F.round(sketch.SHORTLIST / F.count("*"), 4).alias("compared"))
    return vector.recall(knn_exact(t), knn_sketched(t), 10).crossJoin(F.broadcast(chunks))


@query("truncated_vectors", sql(VECTORS, body=""",
heads AS (SELECT vec_id, v[1:16] AS h, sqrt(list_dot_product(v[1:16], v[1:16])) AS n FROM vectors)
SELECT vec_id, len(h) AS dims, round(list_sum(h) / n, 6) AS total, CAST(1 AS DOUBLE) AS norm FROM heads"""))
def _(t):
    short = t.vectors().select("vec_id", vectors.truncate(F.col("embedding"), 16).alias("h"))
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    return short.select("vec_id", F.size("h").alias("dims"), F.round(total, 6).alias("total"),
                        F.round(vectors.norm(F.col("h")), 6).alias("norm"))


SWEEP = (8, 16, 32)


@query("dimension_sweep", sql(VECTORS, nearest_sql(10), *[f"""
near{d} AS (
  SELECT query_id, chunk_id FROM query_vectors, vectors QUALIFY row_number() OVER (
    PARTITION BY query_id ORDER BY {distance_sql(f"q[1:{d}]", f"v[1:{d}]")}, chunk_id) <= 10)"""
    for d in SWEEP], body=" " + " UNION ALL ".join(f"""
SELECT {d} AS dims, 10 AS k, (SELECT count(*) FROM near) AS expected, count(*) AS found,
  round(count(*) / (SELECT count(*) FROM near), 4) AS recall
FROM near JOIN near{d} USING (query_id, chunk_id)""" for d in SWEEP)))
def _(t):
    truth = knn_exact(t)
    rows = None
    for d in SWEEP:
        chunks = t.vectors().select("chunk_id", vectors.truncate(F.col("embedding"), d)
                                    .alias("embedding"))
        asked = t.query_vectors().select("query_id", vectors.truncate(F.col("vector"), d)
                                         .alias("vector"))
        row = vector.recall(truth, vector.nearest(chunks, asked, 10), 10).withColumn(
            "dims", F.lit(d))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("text_embedding", sql(PASSAGES, body="""
SELECT DISTINCT text_hash, 32 AS dims, CAST(1 AS DOUBLE) AS norm FROM passages"""))
def _(t):
    texts = t.lines().groupBy("text_hash").agg(F.min("text").alias("text"))
    embedded = texts.select("text_hash", vectors.hash_embedder(32).column(F.col("text"))
                            .alias("v"))
    return embedded.select("text_hash", F.size("v").alias("dims"),
                           F.round(vectors.norm(F.col("v")), 4).alias("norm"))


# ---- hybrid --------------------------------------------------------------------------------------

FUSED = """
fused AS (
  SELECT query_id, chunk_id, lexical_rank, vector_rank,
    coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0) AS rrf
  FROM ranked_lexical FULL JOIN near USING (query_id, chunk_id)),
dedup AS (
  SELECT f.*, p.record_id, p.type, p.name, p.source,
    row_number() OVER (PARTITION BY query_id, record_id ORDER BY rrf DESC, chunk_id) AS rn_record,
    row_number() OVER (PARTITION BY query_id, text_hash ORDER BY rrf DESC, chunk_id) AS rn_text
  FROM fused f JOIN passages p USING (chunk_id)),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank
  FROM dedup WHERE rn_record = 1 AND rn_text = 1 QUALIFY rank <= 10)"""

SHOWN = ("query_id", "chunk_id", "record_id", "type", "name", "source", "lexical_rank",
         "vector_rank", "mode", "rank")


@query("hybrid_search", sql(PASSAGES, VECTORS, HYBRID_TEXTS, LEXICAL, nearest_sql(
    100, "chunk_id IN (SELECT chunk_id FROM passages)"), FUSED,
                            body="""
SELECT query_id, chunk_id, record_id, type, name, source, lexical_rank, vector_rank,
  'hybrid' AS mode, rank, round(rrf, 6) AS rrf_score FROM hits"""))
def hybrid_search(t):
    queries = t.hybrid_queries()
    fused = fuse.fuse(best(t, queries),
                      vector.nearest(t.passages(), t.query_vectors(), lexical.CANDIDATES))
    return fuse.hits(fused, t.lines()).select(
        *SHOWN, F.round("rrf_score", 6).alias("rrf_score"))


@query("hybrid_all_queries", sql(PASSAGES, VECTORS, HYBRID_TEXTS, LEXICAL, nearest_sql(
    100, "chunk_id IN (SELECT chunk_id FROM passages)"), FUSED,
                                 body="""
SELECT query_id, chunk_id, record_id, type, name, source, lexical_rank, vector_rank,
  'hybrid' AS mode, rank, round(rrf, 6) AS rrf_score FROM hits"""))
def _(t):
    return hybrid_search(t)


@query("lexical_only_search", sql(PASSAGES, QUERY_TEXTS, LEXICAL, """
near AS (SELECT NULL AS query_id, NULL AS chunk_id, CAST(NULL AS INT) AS vector_rank WHERE false)""",
    FUSED, body="""
SELECT query_id, chunk_id, record_id, type, name, source, lexical_rank, vector_rank,
  'lexical' AS mode, rank FROM hits"""))
def _(t):
    fused = fuse.fuse(best(t, t.benchmark_queries()), None)
    return fuse.hits(fused, t.lines()).select(*SHOWN)


@query("remedy_recommendation", sql(TELEMETRY, CONTENT, gates_sql(), REMEDIES, LABEL_VECTORS, body=f""",
demands AS (SELECT DISTINCT stat, stat_kind, gap_p90 FROM gates),
eligible AS (
  SELECT d.*, r.record_id || '#' || CAST(r.ordinal AS VARCHAR) AS chunk_id,
    {distance_sql("q", "v")} AS distance
  FROM demands d JOIN remedies r ON r.affected = d.stat AND r.affected_kind = d.stat_kind
    AND r.magnitude_max >= d.gap_p90
  JOIN vectors x ON 'Part_' || CAST(x.vec_id AS VARCHAR) = r.record_id
  JOIN label_vectors y ON 'label' || substr(d.stat, 3) = y.query_id)
SELECT stat || '/' || stat_kind || '/' || CAST(gap_p90 AS VARCHAR) AS query_id, chunk_id, distance,
  row_number() OVER (PARTITION BY stat, stat_kind, gap_p90 ORDER BY distance, chunk_id)
    AS vector_rank
FROM eligible QUALIFY vector_rank <= 5"""))
def _(t):
    rows = sufficiency.remedies(t.effects(), t.records(),
                                sufficiency.placement_tally(t.sightings()))
    vecs = t.raw("embeddings").select(
        F.concat(F.lit("Part_"), F.col("vec_id").cast("string")).alias("record_id"), "embedding")
    chunks = rows.join(vecs, "record_id").filter("magnitude_max IS NOT NULL").select(
        F.concat_ws("/", "affected", "affected_kind").alias("cell"),
        F.concat_ws("#", "record_id", F.col("ordinal").cast("string")).alias("chunk_id"),
        "embedding", F.col("magnitude_max").alias("strength"))
    demands = sufficiency.gate_gaps(t.unordered()).select("stat", "stat_kind", "gap_p90").distinct()
    asked = demands.join(t.label_vectors(),
                         F.col("label") == F.concat(F.lit("label"), F.substring("stat", 3, 9)))
    return vector.nearest_within(chunks, asked.select(
        F.concat_ws("/", "stat", "stat_kind").alias("cell"),
        F.concat_ws("/", "stat", "stat_kind", F.col("gap_p90").cast("string")).alias("query_id"),
        "vector", F.col("gap_p90").alias("at_least")), 5)
