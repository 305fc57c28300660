"""Registry of named queries, each paired with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulse.sources.tables import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    load()
    return {name: bind(fn) for name, fn in QUERIES.items()}


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)


def load() -> None:
    """Import the modules that register queries."""
    from pulse.plans import (  # noqa: F401
        queries_corpus, queries_events, queries_insights, queries_rollup, queries_search,
        queries_stats)
