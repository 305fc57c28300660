"""Evidence for generated insights, bulk checks of their texts, and the review life cycle.

The texts come from outside as a table; the engine gathers what they may rely on and checks that
they rely on nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.operators.sufficiency import GATE

NARRATIVE_TYPES = ("INFO", "BOOK")
NUMBER = r"\d+(?:\.\d+)?"
PUBLISHED_LIMIT = 50

# Fixed list: words that claim something can be obtained, which the data cannot show.
OBTAINABILITY_TERMS = (
    "merchant", "vendor", "apothecary", "apothecaries", "trader", "shop", "store",
    "buy", "bought", "purchase", "sell", "sold", "stock", "stocks", "stocked",
    "obtain", "obtainable", "acquire", "find one", "easy to get", "readily available")


# ---- evidence ------------------------------------------------------------------------------------

# Fixed value: another wording would find other passages. The stat stands in both places.
SITUATION = "how can I improve my %s, or get help passing a difficult %s check"
CANDIDATE_PASSAGES = 40  # hits of each search before filtering; fixed by the contract


def situation_text(stat: Column, template: str = SITUATION) -> Column:
    """Search text for prose about being short of a stat."""
    return F.format_string(template, stat, stat)


def name_queries(top_remedies: DataFrame, joiner: str = " ") -> DataFrame:
    """One search text per gate from the names of its strongest remedies (at most six)."""
    named = top_remedies.groupBy(*GATE).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]).alias("n"))
    return named.select(gate_id().alias("query_id"), F.array_join("n", joiner).alias("text"))


def gate_id() -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in GATE])


def assemble(gates: DataFrame, top_remedies: DataFrame, passages: DataFrame) -> DataFrame:
    """Gate + its remedies (<= 6) + its passages (<= 8) as one evidence row with a status.

    Both lists are bounded top-k results, so collecting them per gate is safe.
    """
    remedies = top_remedies.groupBy(*GATE).agg(F.sort_array(F.collect_list(F.struct(
        "rank", "record_id", "name", "type", "magnitude_min", "magnitude_max"))).alias("remedies"))
    found = passages.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
        "place", "record_id", "name", F.col("snippet").alias("text")))).alias("passages"))
    return (gates.withColumn("query_id", gate_id())
            .join(remedies, list(GATE), "left").join(found, "query_id", "left")
            .withColumn("remedies", F.coalesce("remedies", F.array()))
            .withColumn("status", F.when(F.col("passages").isNull(), "no_evidence")
                        .otherwise("ready"))
            .withColumn("passages", F.coalesce("passages", F.array())))


def requested_status(keys: DataFrame, evidence: DataFrame) -> DataFrame:
    """Status per requested gate key: ready, no_evidence, or no_gate when no gate matches it."""
    return keys.select(*GATE).distinct().join(
        evidence.select(*GATE, "status"), list(GATE), "left").withColumn(
        "status", F.coalesce("status", F.lit("no_gate")))


def evidence_json(evidence: DataFrame) -> DataFrame:
    """Add the serialised evidence that numbers in a text are checked against."""
    fields = [c for c in evidence.columns if c not in ("query_id", "status")]
    return evidence.withColumn("evidence", F.to_json(F.struct(*fields)))


# ---- checks --------------------------------------------------------------------------------------

def _violation(rule: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))


def violations() -> Column:
    """Every rule a candidate breaks, over its text columns, `citations` and the evidence."""
    prose = ("headline", "rationale", "recommendation")
    empty = F.transform(
        F.filter(F.array(*[F.struct(F.lit(p).alias("field"), F.col(p).alias("text"))
                           for p in prose]),
                 lambda f: F.regexp_replace(f["text"], r"\s", "") == ""),
        lambda f: _violation("empty_field", f["field"]))
    allowed = F.regexp_extract_all("evidence", F.lit(NUMBER), F.lit(0))
    used = F.flatten(F.array(*[F.regexp_extract_all(p, F.lit(NUMBER), F.lit(0)) for p in prose]))
    numbers = F.transform(F.filter(used, lambda n: ~F.array_contains(allowed, n)),
                          lambda n: _violation("unknown_number", n))
    supplied = F.transform(F.concat(
        F.transform("remedies", lambda r: r["record_id"]),
        F.transform("passages", lambda r: r["record_id"])), F.lower)
    citations = F.transform(
        F.filter("citations", lambda c: ~F.array_contains(supplied, F.lower(c))),
        lambda c: _violation("uncited_record", c))
    text = F.lower(F.concat_ws(" ", *prose))
    terms = F.array(*[F.lit(term) for term in OBTAINABILITY_TERMS])
    claims = F.transform(F.filter(terms, lambda term: F.contains(text, term)),
                         lambda term: _violation("reachability_claim", term))
    return F.concat(empty, numbers, citations, claims)


def check(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates next to the evidence of exactly their gate, with all `violations`."""
    return (candidates.join(evidence_json(evidence).select(
        *GATE, "remedies", "passages", "evidence"), list(GATE))
        .withColumn("violations", violations()))


def accept(checked: DataFrame, created_at: Column, prompt_version: int, model: str) -> DataFrame:
    """Clean candidates as pending rows; rejected ones are not stored."""
    return checked.filter(F.size("violations") == 0).select(
        *GATE, "headline", "signposting", "rationale", "recommendation", "citations", "evidence",
        F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"),
        created_at.alias("created_at"), F.lit("pending").alias("status"))


# ---- review --------------------------------------------------------------------------------------

def review(insights: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions: only pending rows move, and only by their first decision."""
    known = decisions.filter(F.col("decision").isin("approved", "rejected"))
    first = known.groupBy("id").agg(
        F.min(F.struct("decided_at", "decision")).alias("d"))
    moved = (F.col("status") == "pending") & F.col("d").isNotNull()
    return (insights.join(first, "id", "left")
            .withColumns({"reviewed_at": F.when(moved, F.col("d.decided_at")),
                          "status": F.when(moved, F.col("d.decision"))
                          .otherwise(F.col("status"))}).drop("d"))


def published(insights: DataFrame, check_id: str | None = None) -> DataFrame:
    """Approved only, newest first, without the evidence."""
    rows = insights.filter(F.col("status") == "approved")
    if check_id:
        rows = rows.filter(F.col("check_id") == check_id)
    return rows.drop("evidence").orderBy(F.desc("created_at"), F.desc("id")).limit(PUBLISHED_LIMIT)


def review_queue(insights: DataFrame) -> DataFrame:
    """Pending, oldest first, with the evidence a reviewer needs."""
    return (insights.filter(F.col("status") == "pending")
            .orderBy(F.asc("created_at"), F.asc("id")).limit(PUBLISHED_LIMIT))


def drifted(insights: DataFrame, current: int) -> DataFrame:
    return insights.filter(F.col("prompt_version") < current)


def with_insight(gates: DataFrame, insights: DataFrame) -> DataFrame:
    """Each gate with its newest approved insight, matched on all four key fields."""
    newest = (insights.filter(F.col("status") == "approved").groupBy(*GATE)
              .agg(F.max(F.struct("created_at", "id")).alias("n"))
              .select(*GATE, F.col("n.id").alias("insight_id")))
    return gates.join(newest, list(GATE), "left")


def rank_again(hits: DataFrame) -> DataFrame:
    """Close the gaps that filtering left in a bounded hit list."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(order))
