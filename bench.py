"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` picks the data, ``BENCH_CPUS`` the cores.  Each query runs once
to warm up and is then timed ``BENCH_RUNS`` times (median).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

import catalog
from formloom.session import tuned

HEADLINE = (
    "form_diff", "form_compliance", "structured_placements", "order_issues", "line_slugs", "line_kinds",
    "duplicate_documents", "page_elements", "form_layouts", "form_content", "owner_usage", "prune_files",
    "latest_shipments", "part_labels", "merged_answers", "draft_edits",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES")
    spark = tuned(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.collect("QUERIES")
    times: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        took = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
