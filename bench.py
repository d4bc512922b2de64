"""Time the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line.  Every query is built and run to completion (all columns of all
rows, through the ``noop`` sink); the time is the best of two runs after one warm-up of
the session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "parse_all",
    "feature_join",
    "clean_medians",
    "temporal_features",
    "behavior_features",
    "session_plays",
    "session_plays_by_user",
    "session_gaps",
    "session_stats",
    "session_patterns",
    "derived_metrics",
    "daily_stats",
    "weekly_stats",
    "monthly_stats",
    "artist_stats",
    "time_stats",
    "seasonal_stats",
    "yearly_growth",
    "platform_stats",
    "efficiency_stats",
    "top_efficient_artists",
    "cluster_analysis",
    "insights",
    "kpis",
    "heatmap_hour_weekday",
    "session_minutes_histogram",
    "summary_report",
)


def main() -> None:
    from checks import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("playtrail-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    run("daily_stats")
    seconds = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
