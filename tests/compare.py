"""Run registered queries in Spark and their SQL in DuckDB, and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return repr(value) if not isinstance(value, str) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, oracle: str | None, folder: str) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if oracle is None:
        return True, f"rows={len(got)} {took:.1f}s (rows only)"
    rel = con.execute(oracle)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return bool(a), f"rows={len(a)} {took:.1f}s"
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return False, f"{len(a)} vs {len(b)} rows\n  spark {only_a}\n  duck  {only_b}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf = sys.argv[1]
    folder = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, queries[name], oracles.get(name), folder)
        except Exception as error:  # report and go on to the next query
            ok, note = False, str(error)[:1500]
        print("ok  " if ok else "FAIL", name, note, flush=True)
        bad += [] if ok else [name]
    print(f"{len(names) - len(bad)}/{len(names)} match; failing: {bad}")
