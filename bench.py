"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from riskspark.queries import QUERIES  # noqa: E402

HEADLINE = ("risk_metrics_by_race", "qi_sensitivity_by_race", "privacy_utility_frontier", "protection_utility_cells", "risk_by_residential_density", "class_diversity", "uniqueness_by_group_size", "size_matched_ratio", "permutation_null", "population_uniqueness_subsample", "adjusted_disparity")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()  # longer methods are never compiled by the JVM
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["fct_application"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up and file cache
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
