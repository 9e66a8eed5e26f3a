"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR: the folder of tables; BENCH_CPUS: local threads. Each query is run once to warm up
(unless BENCH_WARM is 0) and then timed while all of its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from larkspur import plans  # noqa: E402
from larkspur.sources.session import clear  # noqa: E402

HEADLINE = [
    "auc_by_lang", "roc_curve", "roc_grid_interp", "clf_metrics", "cross_entropy", "reg_metrics", "bootstrap_percentile_ci", "paired_diff_ci", "best_per_group",
    "outlier_iqr", "outlier_sequential", "feature_stats", "embedding_mean_stats", "pivot_wide", "outer_merge", "dedup_first", "smd_balance", "mwu_stat", "spearman",
    "bh_adjust", "chi2_stat", "kfold_stratified", "standardize", "regress_out", "knn", "nearest_pairs", "matched_pairs", "matched_split", "nested_cv", "calibrated_scores",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for timed in ([False] if os.environ.get("BENCH_WARM", "1") != "0" else []) + [True]:
            began = time.perf_counter()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                took[name] = round(time.perf_counter() - began, 3)
            clear(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
