"""Environment scope, explorer filters and confidence flags as Columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SYNTHETIC = "synthetic"
SCOPES = ("real", "synthetic", "all")
LOW_CONFIDENCE_BELOW = 20

_NOTES = {
    "real": "Generated rows are excluded.",
    "synthetic": "Generated rows only; these figures describe no player.",
    "all": "Generated and real rows are mixed; do not read these as player behaviour.",
}

_EQUALITY_FILTERS = ("mod_id", "type", "env", "session_id", "suspect", "topic", "reason")


def parse_scope(raw: str | None) -> str:
    """Unknown input narrows to real rows; it never widens."""
    return raw if raw in ("synthetic", "all") else "real"


def env_predicate(scope: str, env: Column | None = None) -> Column:
    """Real is an exclusion, so an environment nobody listed still counts as real."""
    env = F.col("env") if env is None else env
    if scope == "all":
        return F.lit(True)
    return env == SYNTHETIC if scope == "synthetic" else env != SYNTHETIC


def env_note(scope: str) -> str:
    return _NOTES[parse_scope(scope)]


def explorer_filters(filters: Mapping[str, object]) -> Column:
    """AND of the known filters that are present; unknown keys and blanks add nothing."""
    parts = [F.col(k) == str(filters[k]).strip() for k in _EQUALITY_FILTERS
             if str(filters.get(k) or "").strip()]
    if filters.get("from") is not None:
        parts.append(F.col("ts") >= F.timestamp_millis(F.lit(int(filters["from"]))))
    if filters.get("to") is not None:
        parts.append(F.col("ts") <= F.timestamp_millis(F.lit(int(filters["to"]))))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def low_confidence(n: Column) -> Column:
    """Flag thin samples so a reader de-emphasises them; rows are never hidden."""
    return n < LOW_CONFIDENCE_BELOW
