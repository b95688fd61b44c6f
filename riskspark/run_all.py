"""All marts in an order in which each comes after what it is made from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from riskspark import io
from riskspark.queries import QUERIES

#: The published marts: tables first, then risk, density, protection, utility and governance.
MARTS = (
    "fct_application", "tract_context", "risk_cohort_counts", "risk_metrics_by_race", "qi_sensitivity_by_race", "tract_release_density", "tract_residential_density", "risk_by_release_density", "risk_by_residential_density",
    "risk_by_density_cross", "density_association", "density_join_exclusion_audit", "protection_equivalence_classes", "protection_utility_cells", "privacy_utility_frontier", "fair_lending_cohort_counts", "class_diversity", "uniqueness_by_group_size",
    "size_matched_ratio", "population_uniqueness_subsample", "gamma_poisson_uniqueness", "synthetic_linkage", "permutation_null", "group_size_decision", "adjusted_disparity", "frontier_metadata", "release_bundle",
)


def run_all(spark: SparkSession, source: str, target: str, marts: Sequence[str] = MARTS) -> DataFrame:
    """Write each mart as a Parquet table below target; (mart, rows, path) of what was written.

    A table that is there already is kept, so a run that was cut short goes on where it stopped; a half-written one has no _SUCCESS and is written anew.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = []
    for name in marts:
        path = f"{target.rstrip('/')}/{name}"
        folder, mark = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        fs = folder.getFileSystem(conf)
        if not fs.exists(mark):
            fs.delete(folder, True)
            io.materialize_mart(QUERIES[name](spark, source), path)
        done.append((name, spark.read.parquet(path).count(), path))
    return spark.createDataFrame(done, "mart string, rows long, path string")
