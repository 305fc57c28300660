"""The code scan against exact search: recall, work done, blocks, and rows without a direction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.operators import sketch, vector
from pulse.session import stored


def frames(spark, data, queries):
    chunks = spark.createDataFrame([(f"c{i:05d}", [float(x) for x in v]) for i, v in enumerate(data)], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(queries)], "query_id string, vector array<float>")
    return chunks.repartition(4), asked


@pytest.mark.parametrize("width, clusters", [(64, 0), (33, 12), (8, 0)])
def test_recall_at_ten(spark, width, clusters):
    """A shortlist of 100 among 6,000 (a sixtieth of the distances) keeps at least 0.9 of the true ten."""
    rnd = np.random.default_rng(width)
    centres = rnd.normal(size=(clusters or 1, width)) * (1 if clusters else 0)
    data = centres[rnd.integers(0, len(centres), 6000)] + rnd.normal(size=(6000, width)) * (0.4 if clusters else 1)
    chunks, asked = frames(spark, data, data[::200] + rnd.normal(size=(30, width)) * 0.1)
    truth = vector.nearest(chunks, asked, 10)
    found = sketch.nearest(chunks, asked, 10)
    row = vector.recall(truth, found, 10).first()
    assert row.expected == 300 and row.recall >= 0.9
    # distances of what was found are exact
    both = truth.join(found.withColumnRenamed("distance", "other"), ["query_id", "chunk_id"])
    assert both.filter(F.abs(F.col("distance") - F.col("other")) > 1e-6).count() == 0


def test_given_vectors(spark, tables):
    chunks, asked = tables.vectors(), tables.query_vectors()
    book = sketch.train(chunks)
    pairs = sketch.shortlist(sketch.encode(chunks, book), asked, book)
    total = chunks.count() * asked.count()
    assert pairs.count() * 4 <= total
    found = sketch.nearest(chunks, asked, 10, book=book)
    assert vector.recall(vector.nearest(chunks, asked, 10), found, 10).first().recall >= 0.9
    # the same shortlist whatever the blocks
    small = sketch.shortlist(sketch.encode(chunks, book), asked, book, block=60, query_block=4)
    assert small.exceptAll(pairs).isEmpty() and pairs.exceptAll(small).isEmpty()


def test_rows_without_direction(spark):
    schema = "chunk_id string, embedding array<float>"
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<float>")
    rows = [("a", [1.0, 0.0, 0.0]), ("b", [2.0, 0.0, 0.0]), ("none", None), ("zero", [0.0, 0.0, 0.0]), ("far", [-1.0, 0.0, 0.0])]
    got = sketch.nearest(spark.createDataFrame(rows, schema), asked, 10).orderBy("vector_rank").collect()
    assert [(r.chunk_id, r.distance) for r in got] == [("a", 0.0), ("b", 0.0), ("far", 2.0)]
    assert sketch.nearest(spark.createDataFrame([], schema), asked, 3).collect() == []
    assert sketch.nearest(spark.createDataFrame(rows, schema), asked.limit(0), 3).collect() == []


def test_codes_are_close(spark):
    rnd = np.random.default_rng(3)
    data = rnd.normal(size=(4000, 64))
    book = sketch.fit(data)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    held = book.decode(book.encode(data))
    assert book.encode(data).shape == (4000, 32) and np.mean(((unit @ book.turn) - held) ** 2) < 0.01 * np.mean(unit ** 2)


def test_recall_curve_with_latencies(spark, tables):
    chunks, asked = tables.vectors(), tables.query_vectors()
    book = sketch.train(chunks)
    codes = stored(sketch.encode(chunks, book), "codes")
    truth = vector.nearest(chunks, asked, 10)
    got = vector.recall_curve(lambda q, n: sketch.nearest(chunks, q, 10, n, book, codes), truth, asked, (10, 40, 100), 10, timed=2)
    rows = got.orderBy("setting").collect()
    assert [r.setting for r in rows] == [10, 40, 100] and {r.expected for r in rows} == {10 * asked.count()}
    assert rows[0].recall <= rows[1].recall <= rows[2].recall and rows[2].recall >= 0.9
    assert all(0 < r.p50_ms <= r.p95_ms for r in rows)
