"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion through the ``noop`` sink (every row is
produced, nothing is collected) and timed on a warm session.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from capgraph.plans import catalog  # noqa: E402
from capgraph.session import local_session  # noqa: E402

HEADLINE = [
    # graph algorithms (the reference's measured operators)
    "pagerank_fixed", "pagerank_converged", "connected_components", "triangle_count",
    "clustering", "graph_features", "algorithm_dispatch",
    # run analytics, thresholds, policies, optimiser
    "algorithm_profile", "deadline_hit_rates_by_algorithm", "resource_correlation",
    "cheapest_passing_config", "systematic_sample", "speedup_efficiency",
    "policy_metrics", "deadline_optimizer", "validation_summary",
    # a fitted model
    "runtime_model_rf",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    # Shuffle partitions sized to the data: at these scale factors one per core.
    parts = int(os.environ.get("BENCH_PARTITIONS", cpus if cpus.isdigit() else "8"))
    spark = local_session(cpus, shuffle_partitions=parts, app="capgraph-bench")
    qs = catalog.queries()
    # warm-up: JVM, parquet footers, codegen caches
    qs["graph_vertices"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
