"""Registered queries: dump and survey parsing, chunking, refresh and reconciliation."""

from pyspark.sql import functions as F

from pulse.functions import text
from pulse.functions.vectors import hash_embedder
from pulse.operators import corpus
from pulse.operators.sufficiency import placement_tally
from pulse.plans import corpus_refresh
from pulse.plans.catalog import query
from pulse.plans.twin import CONTENT, DOCS, sql
from pulse.plans.versions import Versions
from pulse.session import scratch_path, stored
from pulse.sources import dump, survey

MODEL = hash_embedder(32)


# ---- dump ----------------------------------------------------------------------------------------

@query("dump_records", sql(CONTENT, body="""
SELECT CASE type WHEN 'INFO' THEN 'topic ' || record_id || '#' || record_id ELSE record_id END
    AS record_id, type,
  CASE type WHEN 'INFO' THEN 'topic ' || record_id WHEN 'ENCH' THEN NULL ELSE name END AS name,
  CASE type WHEN 'BOOK' THEN full_text || chr(10) || chr(10) || 'Record: NPC_ "quoted"' || chr(10)
                             || 'Name: not a field'
            WHEN 'ENCH' THEN record_id ELSE full_text END AS full_text
FROM records
UNION ALL SELECT 'CELL:' || n_name, 'CELL', n_name, n_name FROM nation
UNION ALL SELECT 'SKIL:' || CAST(r_regionkey AS VARCHAR), 'SKIL', r_name, 'About ' || r_name
  FROM region"""))
def _(t):
    return dump.records(dump.parse(t.dump_rows())).drop("file")


@query("dump_effects", sql(CONTENT, body="""
SELECT record_id, ordinal, CASE effect_name WHEN 'Drain Attribute' THEN 17 ELSE 79 END AS effect_id,
  effect_name, affected, affected_kind, magnitude_min, magnitude_max,
  CASE WHEN magnitude_min IS NOT NULL THEN duration END AS duration,
  CASE WHEN magnitude_min IS NOT NULL THEN 'self' END AS range
FROM effects"""))
def _(t):
    return dump.effects(dump.parse(t.dump_rows()))


@query("dump_conservation", sql(CONTENT, body=""",
n AS (SELECT (SELECT count(*) FROM records) + (SELECT count(*) FROM nation)
        + (SELECT count(*) FROM region) AS emitted,
        (SELECT count(*) FROM nation) AS skipped,
        (SELECT count(*) FROM records WHERE type = 'INFO') AS container,
        (SELECT count(*) FROM effects) AS effects)
SELECT emitted + skipped + container AS headers, emitted, skipped, container,
  effects AS effect_lines, effects, true AS conserved
FROM n"""))
def _(t):
    return dump.conservation(dump.parse(t.dump_rows()))


# ---- survey --------------------------------------------------------------------------------------

def survey_lines(t):
    """A finished survey log: begin, header, one line per placement, footer."""
    tally = stored(placement_tally(t.sightings()), "tally")  # the lines and the totals read it

    def tagged(body):
        return F.concat(F.lit("[I] Global[survey]: OMWAS1 "), F.to_json(body))

    placed = tally.select(F.lit(3).alias("pos"), tagged(F.struct(
        F.lit("placement").alias("kind"), "area", "is_exterior",
        F.upper("item_record_id").alias("item_id"), "count")).alias("line"))
    totals = tally.agg(F.count("*").alias("n"), F.count_distinct("area").alias("cells"))
    order = F.array(*[F.lit(f) for f in ("Morrowind.esm", "Tribunal.esm", "Bloodmoon.esm")])
    frame = totals.select(F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.lit('OMWAS1 {"kind":"begin"}').alias("line")),
        F.struct(F.lit(2).alias("pos"), tagged(F.struct(
            F.lit("header").alias("kind"), order.alias("load_order"),
            F.col("cells").alias("cells_scanned"))).alias("line")),
        F.struct(F.lit(4).alias("pos"), tagged(F.struct(
            F.lit("footer").alias("kind"), F.col("n").alias("rows"))).alias("line")))).alias("x"))
    return placed.unionByName(frame.select("x.pos", "x.line"))


@query("survey_checks", sql(CONTENT, body="""
SELECT count(*) AS placements, count(*) AS footer_rows, count(DISTINCT area) AS cells_scanned,
  substr(sha256('Morrowind.esm' || chr(10) || 'Tribunal.esm' || chr(10) || 'Bloodmoon.esm'), 1, 16)
    AS load_order_hash, 0 AS refusals, true AS order_ok
FROM placements"""))
def _(t):
    head = survey.checks(survey.parse(survey_lines(t)))
    return head.select("placements", "footer_rows", "cells_scanned", "load_order_hash",
                       F.size("refusals").alias("refusals"),
                       survey.load_order_verdict(F.col("load_order"))["ok"].alias("order_ok"))


@query("survey_placements", sql(CONTENT, body="""
SELECT area, is_exterior, item_record_id, count FROM placements"""))
def _(t):
    return survey.placements(survey.parse(survey_lines(t)))


# Each damage and what the survey must say to it.
DAMAGES = {"fine": ([], True), "no_footer": (["no footer"], True), "no_header": (["no header"], None),
           "short": (["row count differs from footer"], True), "garbled": (["unreadable line"], True),
           "foreign": ([], False)}


@query("survey_refusals", sql(CONTENT, body="""
SELECT damage, CAST(placed - CASE WHEN damage = 'short' THEN 1 ELSE 0 END AS BIGINT) AS placements, refusals, order_ok
FROM (SELECT count(*) AS placed FROM placements), (VALUES """ + ", ".join(
    f"('{name}', '{';'.join(said)}', {'NULL' if ok is None else str(ok).lower()})"
    for name, (said, ok) in DAMAGES.items()) + """) AS v(damage, refusals, order_ok)"""))
def _(t):
    lines = survey_lines(t)
    holds = {part: F.col("line").contains(f'"kind":"{part}"') for part in ("header", "footer")}
    first = placement_tally(t.sightings()).agg(F.min(F.struct("area", "item_record_id")).alias("f"))
    gone = first.select(F.concat(F.lit('"area":"'), F.col("f.area"), F.lit('"')).alias("a"),
                        F.concat(F.lit('"item_id":"'), F.upper("f.item_record_id"), F.lit('"')).alias("i"))
    # one row: the placement that the short manifest lacks
    marked = lines.crossJoin(F.broadcast(gone))
    damaged = {
        "fine": lines, "no_footer": lines.filter(~holds["footer"]), "no_header": lines.filter(~holds["header"]),
        "short": marked.filter(~(F.col("line").contains(F.col("a")) & F.col("line").contains(F.col("i")))).drop("a", "i"),
        "garbled": lines.unionByName(lines.filter(holds["header"]).withColumn("line", F.lit("OMWAS1 {"))),
        "foreign": lines.withColumn("line", F.replace("line", F.lit("Bloodmoon.esm"), F.lit("Other.esp")))}
    found = None
    for name, rows in damaged.items():
        head = survey.checks(survey.parse(rows)).select(
            F.lit(name).alias("damage"), "placements", F.array_join("refusals", ";").alias("refusals"),
            survey.load_order_verdict(F.col("load_order"))["ok"].alias("order_ok"))
        found = head if found is None else found.unionByName(head)
    return found


@query("loaded_survey", sql(CONTENT, body="""
SELECT area, is_exterior, item_record_id, count FROM placements"""))
def _(t):
    # loaded into a store, then read back
    store = Versions(t.spark, scratch_path(t.spark, "survey"))
    survey.load(store, survey_lines(t), F.lit("2024-01-31").cast("timestamp"))
    return store.read("placements")


# ---- text and chunks -----------------------------------------------------------------------------

STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'),
  '</?(?:div|p)\b[^>]*>', chr(10) || chr(10), 'gi'), '<[^>]*>', '', 'g'), '\r', '', 'g'),
  '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '^\s+|\s+$', '', 'g')"""


@query("markup_strip", f"SELECT page_id, url, {STRIP} AS text FROM pages")
def _(t):
    return t.texts("pages", "page_id").select("page_id", "url", text.strip_markup(F.col("html")).alias("text"))


def books(t):
    """Documents as books; each line of a document is a paragraph."""
    return t.documents().withColumns({
        "type": F.lit("BOOK"), "full_text": F.replace("full_text", F.lit("\n"), F.lit("\n\n"))})


# A chunk ends where the next paragraph or sentence no longer fits. The recursion walks the pieces
# of all documents in step and carries only lengths.
BOOK_CHUNKS = r"""
paragraphs AS (
  SELECT record_id, p_no, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p
  FROM (SELECT record_id, unnest(string_split(full_text, chr(10))) AS p,
          unnest(range(0, len(string_split(full_text, chr(10))))) AS p_no FROM docs)),
kept AS (SELECT *, length(p) > 1500 AS long FROM paragraphs WHERE p <> ''),
pieces AS (
  SELECT record_id, p_no, 0 AS s_no, 0 AS grp, p AS piece FROM kept WHERE NOT long
  UNION ALL
  SELECT record_id, p_no, unnest(range(0, len(parts))), p_no + 1, unnest(parts)
  FROM (SELECT record_id, p_no,
          string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts
        FROM kept WHERE long)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY p_no, s_no) AS i FROM pieces),
walk AS (
  SELECT record_id, i, grp, length(piece) AS size, 0 AS ordinal FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.record_id, n.i, n.grp,
    CASE WHEN n.grp = w.grp AND w.size + length(piece) + CASE n.grp WHEN 0 THEN 2 ELSE 1 END <= 1000
      THEN w.size + length(piece) + CASE n.grp WHEN 0 THEN 2 ELSE 1 END ELSE length(piece) END,
    CASE WHEN n.grp = w.grp AND w.size + length(piece) + CASE n.grp WHEN 0 THEN 2 ELSE 1 END <= 1000
      THEN w.ordinal ELSE w.ordinal + 1 END
  FROM walk w JOIN numbered n ON n.record_id = w.record_id AND n.i = w.i + 1),
chunks AS (
  SELECT record_id, ordinal, CASE grp WHEN 0 THEN string_agg(piece, chr(10) || chr(10) ORDER BY i)
    ELSE string_agg(piece, ' ' ORDER BY i) END AS text
  FROM walk JOIN numbered USING (record_id, i, grp) GROUP BY record_id, ordinal, grp)"""


@query("book_chunks", sql(DOCS, BOOK_CHUNKS, recursive=True, body="""
SELECT record_id || '#' || CAST(ordinal AS VARCHAR) AS chunk_id, record_id, ordinal, text,
  sha256(text) AS text_hash
FROM chunks"""))
def _(t):
    return corpus.build_chunks(books(t), t.effects())


PHRASES = """
phrases AS (
  SELECT record_id, string_agg(phrase, '. ' ORDER BY first) AS said
  FROM (SELECT record_id, effect_name || ' ' || affected AS phrase, min(ordinal) AS first
        FROM effects GROUP BY ALL) GROUP BY ALL)"""


@query("search_text", sql(CONTENT, PHRASES, body="""
SELECT record_id, CASE WHEN said IS NULL THEN full_text ELSE full_text || '. ' || said || '.' END
  AS search_text
FROM records LEFT JOIN phrases USING (record_id)"""))
def _(t):
    return corpus.search_text(t.records(), t.effects()).select("record_id", "search_text")


# ---- refresh -------------------------------------------------------------------------------------

SOURCE = "Brand#1"


def stored_corpus(t):
    """The corpus as first loaded. Vectors are left out: change detection reads provenance only,
    and every tenth-size item was embedded by an older model."""
    records, effects = t.records(), t.effects()
    sizes = t.raw("part").select(F.concat(F.lit("Part_"), F.col("p_partkey").cast("string"))
                                 .alias("record_id"), "p_size")
    chunks = corpus.build_chunks(records, effects).join(sizes, "record_id").withColumns({
        "embedding": F.lit(None).cast("array<float>"),
        "embedding_model": F.when(F.col("p_size") % 10 == 0, "older").otherwise(MODEL.model),
        "embedding_dims": F.lit(MODEL.dims)}).drop("p_size")
    return corpus_refresh.CorpusState(records, chunks, effects)


def incoming(t):
    """A new load of one source: large parts of it under changed or old names, some parts taken
    over from another source, and every record printed twice."""
    part = t.raw("part")
    mine = (F.col("p_brand") == SOURCE) & (F.col("p_size") > 10)
    taken = (F.col("p_brand") == "Brand#2") & (F.col("p_size") > 40)
    ids = part.filter(mine | taken).select(
        F.concat(F.lit("Part_"), F.col("p_partkey").cast("string")).alias("record_id"),
        (F.col("p_size") > 30).alias("renamed"))
    named = t.records().join(ids, "record_id")
    first = named.withColumns({"position": F.lit(1), "full_text": F.lit("superseded")})
    last = named.withColumns({"position": F.lit(2), "full_text": F.when(
        F.col("renamed"), F.concat("full_text", F.lit(" II"))).otherwise(F.col("full_text"))})
    return first.unionByName(last).drop("renamed")


REFRESH = """
texts AS (
  SELECT record_id, p_brand, p_size,
    CASE WHEN said IS NULL THEN p_name ELSE p_name || '. ' || said || '.' END AS before,
    CASE WHEN p_size > 30 THEN p_name || ' II' ELSE p_name END AS base, said
  FROM part JOIN records ON record_id = 'Part_' || CAST(p_partkey AS VARCHAR)
  LEFT JOIN phrases USING (record_id)),
loaded AS (
  SELECT *, CASE WHEN said IS NULL THEN base ELSE base || '. ' || said || '.' END AS text
  FROM texts
  WHERE (p_brand = 'Brand#1' AND p_size > 10) OR (p_brand = 'Brand#2' AND p_size > 40)),
stale AS (SELECT * FROM loaded WHERE text <> before OR p_size % 10 = 0)"""


@query("stale_chunks", sql(CONTENT, PHRASES, REFRESH, body="""
SELECT record_id || '#0' AS chunk_id, text, sha256(text) AS text_hash FROM stale"""))
def _(t):
    r = corpus_refresh.decide(stored_corpus(t), incoming(t), t.effects(), SOURCE, MODEL)
    return r.stale.select("chunk_id", "text", "text_hash")


@query("source_orphans", sql(CONTENT, PHRASES, REFRESH, body="""
SELECT record_id, 'Brand#1' AS source FROM texts WHERE p_brand = 'Brand#1' AND NOT p_size > 10"""))
def _(t):
    r = corpus_refresh.decide(stored_corpus(t), incoming(t), t.effects(), SOURCE, MODEL)
    return r.orphan_records.select("record_id", "source")


@query("refresh_report", sql(CONTENT, PHRASES, REFRESH, body="""
SELECT (SELECT count(*) FROM loaded) AS duplicate_records_collapsed,
  (SELECT count(*) FROM loaded) AS records_upserted, (SELECT count(*) FROM loaded) AS chunks_total,
  (SELECT count(*) FROM loaded) - (SELECT count(*) FROM stale) AS chunks_skipped,
  (SELECT count(*) FROM stale) AS chunks_written,
  (SELECT count(DISTINCT text) FROM stale) AS texts_embedded,
  (SELECT count(*) - count(DISTINCT text) FROM stale) AS duplicates_collapsed,
  (SELECT count(*) FROM effects JOIN loaded USING (record_id)) AS effects_written,
  (SELECT count(*) FROM texts WHERE p_brand = 'Brand#1' AND NOT p_size > 10)
    AS orphan_records_deleted,
  0 AS orphan_chunks_deleted"""))
def _(t):
    return corpus_refresh.report(
        corpus_refresh.decide(stored_corpus(t), incoming(t), t.effects(), SOURCE, MODEL))


@query("refreshed_corpus", sql(CONTENT, PHRASES, REFRESH, body="""
SELECT t.record_id, CASE WHEN l.record_id IS NULL THEN t.p_brand ELSE 'Brand#1' END AS source,
  coalesce(l.text, t.before) AS text,
  CASE WHEN s.record_id IS NULL AND t.p_size % 10 = 0 THEN 'older' ELSE 'hash-deterministic' END
    AS embedding_model
FROM texts t LEFT JOIN loaded l USING (record_id) LEFT JOIN stale s USING (record_id)
WHERE NOT (t.p_brand = 'Brand#1' AND NOT t.p_size > 10)"""))
def _(t):
    state = stored_corpus(t)
    after = corpus_refresh.apply(state, corpus_refresh.decide(
        state, incoming(t), t.effects(), SOURCE, MODEL), MODEL)
    return after.records.select("record_id", "source").join(
        after.chunks.select("record_id", "text", "embedding_model"), "record_id")


@query("last_wins_records", sql(CONTENT, body="""
SELECT record_id, p_brand AS source, p_name || CASE WHEN p_size > 30 THEN ' II' ELSE '' END
  AS full_text
FROM part JOIN records ON record_id = 'Part_' || CAST(p_partkey AS VARCHAR)
WHERE (p_brand = 'Brand#1' AND p_size > 10) OR (p_brand = 'Brand#2' AND p_size > 40)"""))
def _(t):
    return corpus.last_wins(incoming(t), "position").select("record_id", "source", "full_text")


@query("merged_sources", sql(CONTENT, body="""
SELECT record_id, CASE WHEN p_size > 25 THEN 'patch' ELSE 'base' END AS source,
  CASE WHEN p_size > 25 THEN 'Patched ' || p_name ELSE p_name END AS name
FROM part JOIN records ON record_id = 'Part_' || CAST(p_partkey AS VARCHAR)"""))
def _(t):
    part = t.raw("part").select(
        F.concat(F.lit("Part_"), F.col("p_partkey").cast("string")).alias("record_id"),
        F.col("p_name").alias("name"), "p_size")
    patch = part.filter(F.col("p_size") > 25).withColumn(
        "name", F.concat(F.lit("Patched "), "name"))
    return corpus.merge_sources([("base", part), ("patch", patch)]).select(
        "record_id", "source", "name")


@query("corpus_reconciliation", sql(CONTENT, body=""",
want AS (
  SELECT lower(record_id) AS id, type, count(ordinal) AS n
  FROM records LEFT JOIN effects USING (record_id) GROUP BY ALL),
got AS (
  SELECT lower(record_id) AS id, count(ordinal) FILTER (WHERE affected <> 'st4') AS n
  FROM records LEFT JOIN effects USING (record_id) WHERE type <> 'BOOK' GROUP BY ALL
  UNION ALL SELECT 'cell:' || n_name, 0 FROM nation),
diff AS (
  SELECT want.n AS w, got.n AS g,
    CASE WHEN got.n IS NULL THEN 'missing' WHEN want.n IS NULL THEN 'extra'
         WHEN got.n < want.n THEN 'fewer' WHEN got.n > want.n THEN 'more' ELSE 'same' END AS verdict
  FROM want FULL JOIN got USING (id))
SELECT verdict, count(*) AS records, CAST(coalesce(sum(w), 0) AS BIGINT) AS expected_effects,
  CAST(coalesce(sum(g), 0) AS BIGINT) AS actual_effects
FROM diff GROUP BY ALL"""))
def _(t):
    # the stored side lost books and one stat's effects, and holds places the source never named
    expected = corpus.effect_counts(t.records(), t.effects())
    kept = t.records().filter(F.col("type") != "BOOK").select("record_id")
    places = t.raw("nation").select(F.concat(F.lit("cell:"), "n_name").alias("id"),
                                    F.lit(0).cast("long").alias("effects"))
    actual = corpus.effect_counts(kept, t.effects().filter(F.col("affected") != "st4"))
    return corpus.reconcile(expected, actual.unionByName(places))


@query("provenance_check", """
SELECT CASE WHEN label = 3 THEN 'partial provenance' ELSE 'wrong width' END AS violation,
  count(*) AS chunks
FROM embeddings WHERE label IN (3, 5) GROUP BY ALL""")
def _(t):
    label = F.col("label")
    chunks = t.vectors().withColumns({
        "embedding_model": F.when(label != 3, "m"),
        "embedding_dims": F.when(label == 5, 32).otherwise(F.size("embedding"))})
    return corpus.provenance_violations(chunks).groupBy("violation").agg(
        F.count("*").alias("chunks"))
