"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetspark import catalog  # noqa: E402
from fleetspark.session import build_session  # noqa: E402

HEADLINE = [
    "client_full_inventory", "health_summary", "deployment_history", "inventory_reconcile", "generation_metrics",
    "parse_response_files", "backup_retention", "operation_history", "site_details", "token_validity",
    "build_log_tail", "tenant_scope", "apply_space_deltas", "cascade_delete", "validate_forms", "top_error_lines",
    "build_timeout", "health_windows", "write_backups", "get_latest_health_sql",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("fleetspark-bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # One small run first, so start-up is not charged to the first query.
    catalog.QUERIES["health_trend"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale[1]) if scale else folder,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
