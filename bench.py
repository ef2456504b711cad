"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local parallelism.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from chronopanel.plans import load_queries

HEADLINE = [
    "flagship_features",
    "snk2_write_panel",
    "cls1_classify",
    "jn1_merge_indicators",
    "jn3_merge_timeseries",
    "jn4_build_labels",
    "agg3_resample",
    "agg5_complete_grid",
    "agg11_global_median",
    "agg17_describe",
    "win1_slope",
    "win3_rolling",
    "win5_rolling_skew",
    "win8_ewm",
    "win13_win14_seasonal_additive",
    "win24_forward_fill",
    "win28_backfill_median",
    "win29_imputation_mask",
    "win35_sequences",
    "spl2_split_balanced",
    "spl6_downsample_majority",
    "enc5_robust_scale",
    "evl2_window_metrics",
    "evl3_roc_auc",
    "jn10_imp1_knn_euclidean",
    "jn10_history_join",
    "imp3_forecast_fill",
    "imp4_regression_impute",
    "vec1_pca_transform",
    "vec5_sliding_pca",
    "vec6_dynamic_pca",
    "vec6_dynamic_pair",
    "vec12_knn_graph",
    "mod4_rolling_metrics",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chronopanel-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_queries()[0]
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executors before the clock
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
