"""Typed access to the open JSON payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_CHARS = 140

# Promoted keys: computed once from the payload at the silver write and never set separately.
PROMOTED = {"suspect": "string", "topic": "string", "reason": "string", "passed": "boolean"}


def text(key: str, data: str = "data") -> Column:
    return F.get_json_object(F.col(data), f"$.{key}")


def typed(key: str, kind: str, data: str = "data") -> Column:
    """NULL instead of an error for a value of the wrong type: producers are not trusted."""
    value = text(key, data)
    return value if kind == "string" else value.try_cast(kind)


def has_key(key: str, data: str = "data") -> Column:
    """Key existence; a key holding JSON null exists, which an IS NOT NULL test would miss."""
    return F.array_contains(F.json_object_keys(F.col(data)), key)


def preview(data: str = "data") -> Column:
    """`key=value` line in key order; arrays show their length, objects and nulls a mark."""
    def one(key: Column) -> Column:
        raw = F.try_element_at(F.from_json(F.col(data), "map<string,string>"), key)
        shown = (F.when(raw.isNull(), F.lit("∅"))
                 .when(raw.startswith("{"), F.lit("{…}"))
                 .when(raw.startswith("["),
                       F.concat(F.lit("["), F.json_array_length(raw).cast("string"), F.lit("]")))
                 .otherwise(raw))
        return F.concat(key, F.lit("="), shown)

    line = F.array_join(F.transform(F.json_object_keys(F.col(data)), one), " · ")
    return F.when(F.length(line) > PREVIEW_CHARS,
                  F.concat(F.substring(line, 1, PREVIEW_CHARS), F.lit("…"))).otherwise(line)


def title_case(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def check_label(check_id: Column, prefix: str = "") -> Column:
    """Readable label for `prefix_record:action` ids."""
    parts = F.split(check_id, ":")
    record = title_case(F.regexp_replace(parts[0], f"^{prefix}", "") if prefix else parts[0])
    action = F.try_element_at(parts, F.lit(2))
    return F.when(F.coalesce(action, F.lit("")) != "",
                  F.concat(record, F.lit(" · "), title_case(action))).otherwise(record)
