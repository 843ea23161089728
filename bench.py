"""Times the headline queries and prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from riskbench import catalog

HEADLINE = [
    "clinical_features",
    "audit_duplicates",
    "audit_numeric_profile",
    "split_stratified_folds",
    "split_group_folds",
    "split_duplicate_leakage",
    "metric_summary",
    "metric_best_youden_threshold",
    "harness_threshold_on_train",
    "subgroup_table",
    "impute_train_medians",
    "scale_standardised",
    "select_information",
    "select_screening",
    "select_spearman",
    "cross_pairwise_information",
    "cross_chain_products",
    "similarity_row_sums",
    "report_main_table",
    "test_mcnemar_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["audit_class_balance"](spark, sf_dir).collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
