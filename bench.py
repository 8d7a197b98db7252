"""Headline timings: one JSON line. Each query runs once to warm up and then ``BENCH_REPEAT`` times; the median counts.

The result is written to Spark's no-op sink, so every column of every row is computed and nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from functools import partial

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from rillwork.catalog import load

QUERIES = ["s11_feature_table", "flagship_state_rollup", "a1_positive_mean", "a5_weighted_intensity", "a13_national_crops", "d13_county_rollup",
           "j1_left_chain", "w1_rank_pct", "w2_best_year", "w5_pareto", "w6_rank_and_share", "w7c_county_norm", "p1_low_hanging_fruit", "p3_dual_exposure",
           "a14_distribution", "a16_correlations", "a20_high_low", "a24_series_trend", "m7_naive_effects", "m13_subgroup_effects", "m17_simulate",
           "e4_full_map", "x2_weekly_windows", "r1_raster_opening", "m4_importance_shares", "m9_tree_shap"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else QUERIES
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("rillwork-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    registry = dict(load().QUERIES)
    for name, settings in {"m4_importance_shares": {"trees": 20, "depth": 6}, "m9_tree_shap": {"trees": 8, "depth": 5}}.items():
        registry[name] = partial(load().QUERIES[name], refit=True, **settings)
    seconds = {}
    for name in names:
        runs = []
        for _ in range(repeat + 1):
            start = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
