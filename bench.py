"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ALL=1 for every query, BENCH_ONLY for a list of names.
Each query is run once to warm up and then BENCH_RUNS (default 3) times; the median counts. Results go to
the ``noop`` sink, so that no column is pruned away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lorekeep import registry  # noqa: E402
from lorekeep.session import build_session  # noqa: E402

HEADLINE = (
    "knn_topk",
    "similar_items",
    "hybrid_search",
    "feature_hash_embed",
    "normalize_messages",
    "derived_text",
    "point_payload",
    "classify_changes",
    "apply_sync",
    "processing_snapshot",
    "attach_children",
    "status_counts_by_type",
    "run_status_rollup",
    "latest_per_key",
    "batch_chunks",
    "activity_rate",
    "plan_enrichment",
    "upsert_derived_projection",
    "incremental_scan",
    "throughput_windows",
    "stuck_job_timeout",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    everything = os.environ.get("BENCH_ALL") == "1"
    only = os.environ.get("BENCH_ONLY", "").split()
    runs = int(os.environ.get("BENCH_RUNS", "1" if everything else "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    timings: dict[str, float] = {}
    for name in only or (known if everything else HEADLINE):
        taken = []
        for _ in range(runs + (0 if everything else 1)):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[-runs:]), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    result = {
        "metric": "headline_total_seconds",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
