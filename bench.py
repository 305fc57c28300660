"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores. Each
query is computed in full and its rows are discarded (noop sink); the first, untimed query warms up
the session. What standing jobs write ahead of reads (rollup folds, lexical index) is timed apart.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pulse import session
from pulse.plans import catalog, queries_events, queries_rollup, queries_search
from pulse.sources.tables import Tables

HEADLINE = (
    # the reference's own endpoints and jobs
    "confrontations_by_topic", "failure_reasons", "stuck_ranking", "skill_by_check",
    "failure_distance", "stat_coverage", "routes_taken", "after_failure", "attempts_to_pass",
    "comeback", "gate_sufficiency", "top_remedies", "event_page", "mods_list",
    "fold_partials", "fold_attempts", "hybrid_after_failure", "log_ingest", "idempotent_append",
    # content and retrieval
    "dump_records", "book_chunks", "refresh_report", "lexical_search", "phrase_search", "knn_exact",
    "knn_pruned", "hybrid_search", "evidence_assembly", "insight_checks",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": cpus,
        # a hundred megabytes would otherwise be coalesced to one or two tasks
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.callables()
    names = sys.argv[1:] or HEADLINE
    queries["counts_by_env"](spark, folder).collect()
    # what standing jobs prepare ahead of a read: the event log with its folded rollup, stored keys and the lexical index
    tables, setup = Tables(spark, folder), {}
    for name, prepare in (("rollup_folds", queries_rollup.folded_store), ("appended_log", queries_events.appended_log),
                          ("lexical_index", queries_search.lexical_index)):
        started = time.perf_counter()
        prepare(tables)
        setup[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {setup[name]}", file=sys.stderr, flush=True)
    times = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "setup": setup,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
