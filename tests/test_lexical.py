"""Lexical search in blocks, and what the search queries return."""

import math
import random

import numpy as np
import pytest

from pulse.operators import fuse, lexical
from pulse.plans import catalog


def test_hybrid_all_queries_returns_every_hit(tables):
    catalog.load()
    hits = catalog.QUERIES["hybrid_all_queries"](tables)
    assert {"query_id", "chunk_id", "record_id", "lexical_rank", "vector_rank", "rank", "rrf_score"} <= set(hits.columns)
    assert "GROUP BY query_id" not in catalog.ORACLES["hybrid_all_queries"].rpartition("hits AS")[2]
    asked = tables.hybrid_queries().count()
    assert hits.count() > asked


def test_record_means_and_rounding(spark):
    # 2.0780065 * 10^6 is below .5 as a double: the SQL rounds it down
    scores = spark.createDataFrame([("q", "a#0", 2.0780065)], "query_id string, chunk_id string, score double")
    chunks = spark.createDataFrame([("a#0", "a")], "chunk_id string, record_id string")
    assert fuse.record_scores(scores, chunks).first().score == 2.078006
    assert lexical._half_up(np.array([2.0780065 * 1e6]))[0] == 2078006


def naive(chunks, queries, parsed):
    """Scores of every query and chunk, clause by clause."""
    found = {}
    for chunk, n, words in chunks:
        for q, alts in parsed.items():
            total, any_alt = 0.0, False
            for clauses in alts.values():
                got = []
                for negative, offsets, terms, weight in clauses.values():
                    starts = {p - offsets[0] for p, w in words if w == terms[0]}
                    tf = sum(all((s + o, w) in words for o, w in zip(offsets, terms)) for s in starts)
                    got.append((negative, tf, tf * weight / n))
                if any(not g[0] for g in got) and all((g[1] > 0) != g[0] for g in got):
                    total, any_alt = total + sum(g[2] for g in got if not g[0]), True
            if any_alt:
                found[q, chunk] = round(total, 9)
    return found


def test_search_in_blocks_is_brute_force(spark):
    draw = random.Random(3)
    rows = [(f"r{i // 4}#{i % 4}", f"r{i // 4}", " ".join(draw.choices(["oak", "ash", "elm", "fir", "yew", "box", "the"], k=draw.randint(1, 9))))
            for i in range(120)]
    asked = [("q1", "oak or ash or elm"), ("q2", '"oak ash" or fir -yew'), ("q3", "oak elm"), ("q4", "missing or box"),
             ("q5", '-"elm fir" oak'), ("q6", '"oak the ash"'), ("q7", "-oak"), ("q8", "oak missing")]
    chunks = spark.createDataFrame(rows, "chunk_id string, record_id string, text string")
    words = lexical.parse_queries(spark.createDataFrame(asked, "query_id string, text string"))
    index = lexical.chunk_terms(chunks, "record_id")
    docs = [(r.chunk_id, r.n_terms, set(zip(r.pos, r.terms))) for r in index.collect() if r.n_terms]
    df = {}
    for _, _, held in docs:
        for term in {w for _, w in held}:
            df[term] = df.get(term, 0) + 1
    parsed = {}
    for w in words.orderBy("offset").collect():
        clause = parsed.setdefault(w.query_id, {}).setdefault(w.alt, {}).setdefault(w.clause, [w.negative, [], [], 0.0])
        clause[1].append(w.offset)
        clause[2].append(w.term)
        clause[3] += math.log(1 + len(docs) / df[w.term]) if w.term in df else 0.0
    want = naive(docs, asked, parsed)
    got = lexical.lexical_scores(index, words, block=60, turn=2).collect()
    assert {(r.query_id, r.chunk_id): r.score for r in got} == pytest.approx(want) and len(got) == len(want)

    best = lexical.search(index, words, depth=5, block=60, turn=2).collect()
    expected = {q: sorted((-s, c) for (p, c), s in want.items() if p == q)[:5] for q in {q for q, _ in want}}
    ranked = {q: sorted((r.lexical_rank, r.chunk_id) for r in best if r.query_id == q) for q in expected}
    assert {q: [c for _, c in v] for q, v in ranked.items()} == {q: [c for _, c in v] for q, v in expected.items()}

    per_record = lexical.record_scores(index, words, block=60, turn=2).collect()
    groups = {}
    for (q, c), s in want.items():
        groups.setdefault((q, c.split("#")[0]), []).append(s)
    assert {(r.query_id, r.record_id): r.best for r in per_record} == pytest.approx({k: max(v) for k, v in groups.items()}, abs=2e-6)
    assert {(r.query_id, r.record_id): r.mean for r in per_record} == pytest.approx({k: sum(v) / len(v) for k, v in groups.items()}, abs=2e-6)


def test_a_block_passes_on_no_more_than_the_best(spark):
    chunks = spark.range(30_000).selectExpr("concat('c', id) AS chunk_id", "concat('oak ', id % 7) AS text")
    words = lexical.parse_queries(spark.createDataFrame([("a", "oak"), ("b", "oak or 3")], "query_id string, text string"))
    index = lexical.chunk_terms(chunks)
    found = lexical._meet(index, words, None, lexical._by_chunk(10), "query_id string, chunk_id string, score double", "chunk_id", 20_000, 100)
    assert found.count() == 2 * 3 * 10  # queries, blocks, depth; not one row for each of the matches
    counts = {r.term: (r.occurrences, r.chunks) for r in lexical.term_counts(index).collect()}
    assert counts["oak"] == (30_000, 30_000)
