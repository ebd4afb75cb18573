"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned from scratch and executed in full with the `noop`
sink (every column computed, nothing collected). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "severity_kpi_secrets",
    "secret_scan",
    "pr_stats",
    "chunk_pack",
    "findings_parse",
    "dedupe_cross_reviewer",
    "verdict",
    "review_comment_render",
    "admission_route",
    "message_dedupe",
    "queue_depth_left_join",
    "function_metrics_left_join",
    "completion_barrier",
    "dashboard_refresh",
    "review_pipeline_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    from revlens.plans.registry import QUERIES, load_all
    from revlens.session import configure

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("revlens-bench")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="revlens-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    load_all()
    keys = [k for k in os.environ.get("BENCH_KEYS", ",".join(HEADLINE)).split(",") if k]
    # warm-up: JVM, Python workers, file listing
    QUERIES["pr_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for key in keys:
        t0 = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
