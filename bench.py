"""Run the headline queries and print one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times (2 by default); the median is
reported. Results go to Spark's no-op sink, so every row and column is computed and nothing is
collected to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from geomatch.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "building_status",
    "stage_colours",
    "threshold_metrics",
    "best_match_metrics",
    "file_summary",
    "ranked_pairs",
    "topk_pairs",
    "flatten_last_wins",
    "feature_pivot",
    "feature_lookup",
    "pair_lookup",
    "find_file",
    "object_bbox",
    "footprint_stats",
    "file_bbox",
    "extract_object",
    "comparison_set",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("geomatch-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
