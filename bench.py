"""Benchmark: run the headline queries on ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]`` and print one JSON line.

Each query is executed to completion with the ``noop`` sink (nothing is
collected to the driver); build-time actions of a query (count tables,
quantile bounds) are inside its timing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketsift.plans.catalog import QUERIES  # noqa: E402
from ticketsift.session import local_session  # noqa: E402

HEADLINE = (
    "run_primary",
    "lexical_primary",
    "threshold_labels",
    "category_distribution",
    "multi_tags",
    "top_themes",
    "category_breakdown",
    "apply_merges",
    "categorise_requests",
    "apply_responses",
    "category_samples",
    "running_categories",
    "near_duplicate_categories",
    "grouping_accuracy",
    "conversation_tickets",
    "trend_by_day",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="ticketsift-bench")
    # warm the JVM (JIT and generated code of every headline path) on the
    # smallest scale factor, outside the timings
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).count()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "documents": docs,
        "lexical_rows_per_sec": round(docs / times["lexical_primary"], 1) if times["lexical_primary"] else None,
        # the end-to-end run at full depth (labels, threshold, review, themes):
        # the counterpart of the reference's published rows/s for a full run
        "run_full_rows_per_sec": round(docs / times["run_primary"], 1) if times["run_primary"] else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
