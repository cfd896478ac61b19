"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from pluvia.session import RECOMMENDED  # noqa: E402

HEADLINE = [
    "c3_densify", "d1_lag_features", "d2_rolling_features", "d10_dry_spell_length", "d13_feature_table",
    "d17_feature_statistics", "e2_distribution_stats", "f1_monthly_climatology", "f6_dry_spells",
    "g1_correlation_matrix", "h2_autocorrelation", "h5_decomposition", "l4_comparison_table",
    "o3_central_intervals", "o5_calibration_curve", "h7_adf_tests", "h8_kpss_tests", "g5_binned_trend", "d21_histogram_by_season",
    "o11_conformal_intervals", "n7_linear_dependence",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pluvia-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from pluvia.plans.catalogue import registered

    plans = registered()
    warm = plans["c3_densify"](spark, folder)
    warm.write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
