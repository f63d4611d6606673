"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line {"metric", "value", "unit", "queries", "sf"}.

Each query is timed end to end (plan + all jobs + collecting the result to
the driver).  Before timing, every headline query runs once on smaller
test tables ($BENCH_WARMUP_DIR, default /root/testdata/sf0.001) so that JVM
start-up and JIT/codegen compilation are not billed to the measured run;
set BENCH_WARMUP=0 to time cold.  ``value`` is the sum over the headline
queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.queries import QUERIES  # noqa: E402
from tessera.session import build_session  # noqa: E402

HEADLINE = [
    "panel_labeled",
    "history_features",
    "weekly_covariates",
    "panel_with_covariates",
    "label_balance",
    "grouped_metrics_region",
    "class_report",
    "recent_activity",
    "corridor_signal",
    "recent_covariates",
    "presence_rules",
    "top_values",
    "train_score",
    "stream_recent_activity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="tessera-bench")
    if os.environ.get("BENCH_WARMUP", "1") != "0":
        warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
        for name in names:
            QUERIES[name](spark, warm).collect()
    else:
        QUERIES["partition_profile"](spark, sf_dir).collect()
    times = {}
    for name in names:
        spark.catalog.clearCache()  # no query lives on what another left behind
        t = time.time()
        QUERIES[name](spark, sf_dir).collect()
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
