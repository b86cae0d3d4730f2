"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once cold and a few times warm into the noop sink; its figure is the warm median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from agrispark.plans.registry import all_queries
from agrispark.session import build_session

HEADLINES = {
    "latest state": "latest_per_node",
    "alerts": "threshold_alerts",
    "all-reading alerts": "alert_counts",
    "scoring": "field_health",
    "flags": "param_flags",
    "suitability": "suitability_scores",
    "diagnosis": "action_plan",
    "windows": "windows_24",
    "forecast windows": "windows_48_h24",
    "corpus": "clean_documents",
    "chunking": "document_chunks",
    "sparse retrieval": "bm25_topk",
    "dense retrieval": "dense_topk",
    "fusion": "rrf_topk",
    "utterances": "intent_top",
    "history": "relevant_history",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm_runs = int(os.environ.get("BENCH_WARM_RUNS", "3"))
    names = sys.argv[1:] or list(HEADLINES.values())
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    warm, cold, rows = {}, {}, {}
    for name in names:
        times = []
        for _ in range(warm_runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[name], warm[name] = round(times[0], 3), round(statistics.median(times[1:] or times), 3)
        if os.environ.get("BENCH_ROWS"):
            rows[name] = registered[name](spark, sf_dir).count()
    out = {
        "metric": "warm_median_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }
    if rows:
        out["rows"] = rows
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
