"""Corpus refresh: a no-op on unchanged input, complete on a model swap, careful with orphans."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.functions.vectors import hash_embedder
from pulse.operators import corpus, insights
from pulse.plans import corpus_refresh
from pulse.plans.versions import Versions
from pulse.sources import schemas

MODEL = hash_embedder(16)
BOOK = "\n\n".join("p" * 600 for _ in range(6))


@pytest.fixture
def empty(spark):
    return corpus_refresh.CorpusState(*(spark.createDataFrame([], s) for s in (
        schemas.RECORDS, schemas.CHUNKS, schemas.EFFECTS)))


def records(spark, *rows):
    return spark.createDataFrame([(r[0], None, *r[1:], i) for i, r in enumerate(rows)],
                                 T.StructType([*schemas.RECORDS.fields,
                                               T.StructField("position", T.IntegerType())]))


def base(spark, book=BOOK):
    return records(spark, ("T#1", "INFO", "T", "same words"), ("T#2", "INFO", "T", "same words"),
                   ("Potion", "ALCH", "Brew", "Brew"), ("Book", "BOOK", "A Book", book))


def effects(spark):
    return spark.createDataFrame(
        [("Potion", i, 79, "Fortify Attribute", a, "attribute", 1, 2, 3, "self")
         for i, a in enumerate(("luck", "speed"))], schemas.EFFECTS)


def step(spark, state, rows, source, scratch, model=MODEL, fx=None):
    r = corpus_refresh.decide(state, rows, fx if fx is not None else effects(spark), source, model)
    after = corpus_refresh.apply(state, r, model)
    store = Versions(spark, scratch("corpus"))
    store.write({"records": after.records, "chunks": after.chunks, "effects": after.effects})
    return (corpus_refresh.report(r).first(), corpus_refresh.CorpusState(
        store.read("records"), store.read("chunks"), store.read("effects")))


def test_refresh_life_cycle(spark, empty, scratch):
    first, state = step(spark, empty, base(spark), "base", scratch)
    assert (first.records_upserted, first.chunks_total, first.chunks_written) == (4, 9, 9)
    # two equal dialogue lines and six equal paragraphs are embedded once each
    assert (first.texts_embedded, first.duplicates_collapsed, first.effects_written) == (3, 6, 2)
    assert corpus.provenance_violations(state.chunks).isEmpty()

    again, state = step(spark, state, base(spark), "base", scratch)
    assert (again.chunks_written, again.chunks_skipped, again.texts_embedded) == (0, 9, 0)

    swapped, state = step(spark, state, base(spark), "base", scratch, hash_embedder(16, "other"))
    assert swapped.chunks_written == 9
    assert {r.embedding_model for r in state.chunks.collect()} == {"other"}

    # a shorter book leaves chunks behind; another source's records are not touched
    added, state = step(spark, state, records(spark, ("Extra", "ALCH", "Extra", "Extra")), "mod",
                        scratch)
    assert (added.orphan_records_deleted, added.orphan_chunks_deleted) == (0, 0)
    short, state = step(spark, state, base(spark, "tiny"), "base", scratch,
                        hash_embedder(16, "other"))
    assert (short.orphan_records_deleted, short.orphan_chunks_deleted) == (0, 5)
    gone, state = step(spark, state, base(spark).filter("record_id <> 'Potion'"), "base", scratch)
    assert gone.orphan_records_deleted == 1
    assert {r.record_id for r in state.records.collect()} == {"T#1", "T#2", "Book", "Extra"}
    assert state.effects.isEmpty()
    assert state.chunks.join(state.records, "record_id", "left_anti").isEmpty()


def test_a_record_taken_over_by_another_source(spark, empty, scratch):
    _, state = step(spark, empty, base(spark), "base", scratch)
    taken = records(spark, ("Potion", "ALCH", "Old", "Old"), ("Potion", "ALCH", "New", "New"))
    report, state = step(spark, state, taken, "mod", scratch)
    assert (report.duplicate_records_collapsed, report.records_upserted) == (1, 1)
    row = state.records.filter("record_id = 'Potion'").first()
    assert (row.source, row.name) == ("mod", "New")
    assert state.records.count() == 4


def test_a_text_shared_by_most_chunks(spark):
    chunks = spark.range(3000).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("same").alias("text"),
    ).withColumn("text_hash", F.sha2("text", 256))
    got = corpus.embed_chunks(chunks, MODEL)
    assert got.count() == 3000 and got.select("chunk_id").distinct().count() == 3000
    assert got.filter("text = 'same'").select("embedding").distinct().count() == 1


# ---- insight checks ------------------------------------------------------------------------------

EVIDENCE = ("check_id string, stat string, stat_kind string, threshold int, gap_p90 int, "
            "fails int, remedies array<struct<record_id:string,name:string>>, "
            "passages array<struct<record_id:string,text:string>>, query_id string, status string")
TEXT = ("check_id string, stat string, stat_kind string, threshold int, headline string, "
        "rationale string, recommendation string, signposting string, citations array<string>")


@pytest.mark.parametrize("changes, rules", [
    ({}, []), ({"rationale": "About 95 players."}, ["unknown_number"]),
    ({"citations": ["stranger"]}, ["uncited_record"]), ({"citations": ["POTION_a"]}, []),
    ({"recommendation": "Ask a Merchant."}, ["reachability_claim"]),
    ({"headline": " \n"}, ["empty_field"]), ({"rationale": "A gap of 2.5."}, ["unknown_number"]),
    ({"headline": "", "rationale": "95 sold", "citations": ["x"]},
     ["empty_field", "unknown_number", "uncited_record", "reachability_claim"])])
def test_insight_rules(spark, changes, rules):
    evidence = spark.createDataFrame(
        [("c", "personality", "attribute", 40, 20, 60, [("Potion_A", "Brew")],
          [("info#1", "words 7")], "q", "ready")], EVIDENCE)
    texts = {"headline": "Short by 20", "rationale": "60 failed the 40 check.",
             "recommendation": "Lower it.", "citations": ["potion_a", "info#1"], **changes}
    candidate = spark.createDataFrame(
        [("c", "personality", "attribute", 40, texts["headline"], texts["rationale"],
          texts["recommendation"], "UNCLEAR", texts["citations"])], TEXT)
    checked = insights.check(candidate, evidence)
    assert [v.rule for v in checked.first().violations] == rules
    stored = insights.accept(checked, F.current_timestamp(), 3, "m")
    assert stored.count() == (0 if rules else 1)


def test_insight_needs_the_exact_gate(spark):
    evidence = spark.createDataFrame([("c", "luck", "skill", 40, 1, 1, [], [], "q", "ready")],
                                     EVIDENCE)
    other = spark.createDataFrame([("c", "luck", "skill", 41, "h", "r", "x", "UNCLEAR", [])], TEXT)
    assert insights.check(other, evidence).isEmpty()


def test_first_decision_is_final(spark):
    rows = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "rejected")],
                                 "id int, status string")
    decisions = spark.createDataFrame(
        [(1, 5, "approved"), (1, 9, "rejected"), (3, 1, "approved"), (2, 1, "maybe")],
        "id int, decided_at int, decision string")
    got = {r.id: r.status for r in insights.review(rows, decisions).collect()}
    assert got == {1: "approved", 2: "pending", 3: "rejected"}
