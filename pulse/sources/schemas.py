"""Schemas of stored events and the content corpus."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, TS = (T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(),
                  T.TimestampType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EVENTS = struct(install_id=S, session_id=S, seq=L, type=S, v=I, ts=TS, received_at=TS, env=S,
                mod_id=S, data=S, suspect=S, topic=S, reason=S, passed=B, block=L)

RECORDS = struct(record_id=S, source=S, type=S, name=S, full_text=S)
EFFECTS = struct(record_id=S, ordinal=I, effect_id=I, effect_name=S, affected=S, affected_kind=S,
                 magnitude_min=I, magnitude_max=I, duration=I, range=S)
CHUNKS = T.StructType([
    *struct(chunk_id=S, record_id=S, ordinal=I, text=S, text_hash=S).fields,
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("embedding_model", S), T.StructField("embedding_dims", I)])
