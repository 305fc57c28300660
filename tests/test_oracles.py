"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# At this size these legitimately select nothing.
MAY_BE_EMPTY = {"lexical_search", "phrase_search", "record_rollup", "lexical_only_search"}


@pytest.fixture(scope="module")
def duck():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, note = compare.compare(spark, duck, QUERIES[name], ORACLES.get(name), FOLDER)
    assert ok or (name in MAY_BE_EMPTY and note.startswith("rows=0")), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
