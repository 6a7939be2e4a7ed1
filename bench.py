"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from hourspark import queries as registry
from hourspark.session import build_session

HEADLINE = [
    "hourly_counts", "lag_enhanced_features", "lag_by_self_join", "rolling_past_windows", "base_features", "request_features",
    "feed_mean", "feed_median_shifted", "class_pivot", "recent_enhanced_features", "crowd_canonical", "countline_hours",
    "slot_rollup", "wide_to_long", "unit_coverage", "expectations_report", "key_alignment", "coverage_gaps", "interval_overlaps",
    "metrics_by_scope", "baseline_metrics", "winner_per_group", "stratified_preview", "hash_sample", "empirical_cdf",
    "nearest_site", "grid_snap", "cell_density", "point_density", "edge_dedup", "components", "turns", "path_progress",
    "walked_distance", "arrival_runs", "community_totals", "recent_per_user", "candidate_tags", "stream_hourly",
    "nearest_site_by_grid", "node_penalties", "next_turns", "street_graph", "biased_paths", "long_routes", "stream_walk",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # start-up is not a query
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
