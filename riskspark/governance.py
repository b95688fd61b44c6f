"""Publication rules and data-subject jobs on tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.config import MIN_CELL
from riskspark.shared import broadcast_within

# Fixed column lists.
COUNT_FIELDS = ("record_count", "records", "reference_n", "comparison_n", "reference_n_k5", "comparison_n_k5", "sample_unique_records", "observed_equivalence_classes")
LABEL_FIELDS = ("configuration", "method", "qi_tier", "derived_race", "derived_ethnicity", "residential_density_quintile", "release_density_quintile", "utility_status", "status")
SUBJECT_KEY = "synthetic_subject_key"


def redact(df: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Null all but the labels of rows with a count below the minimum, and say so."""
    if minimum < 2:
        raise ValueError("the minimum cell size must be at least 2")
    counts = [F.coalesce(F.col(c) < minimum, F.lit(False)) for c, t in df.dtypes if c in COUNT_FIELDS and t != "boolean"]
    small = reduce(Column.__or__, counts, F.lit(False))
    cols = [F.col(c) if c in LABEL_FIELDS else F.when(~small, F.col(c)).alias(c) for c in df.columns]
    return df.select(*cols, F.when(small, "suppressed_minimum_cell").alias("suppression_status"), F.when(small, F.lit(minimum).cast("long")).alias("minimum_cell_size"))


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in double columns."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*[F.when(~bad(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def policy_violations(columns: DataFrame, declared: DataFrame, allowed: Sequence[str], restricted: Sequence[str], exceptions: DataFrame, as_of: str) -> DataFrame:
    """(code, model, column) of published columns that aren't classified, or not allowed, or restricted; unexpired exceptions waive.

    columns: (model, column); declared: (model, column, classification); exceptions: (code, model, column, expires_on).
    """
    c = columns.join(declared, ["model", "column"], "left")
    code = F.when(F.col("classification").isNull(), "UNCLASSIFIED_COLUMN").when(~F.col("classification").isin(*allowed), "INVALID_CLASSIFICATION").when(F.col("classification").isin(*restricted), "RESTRICTED_PUBLICATION")
    found = c.withColumn("code", code).where("code is not null").select("code", "model", "column")
    return found.join(exceptions.where(F.col("expires_on") >= F.lit(as_of).cast("date")).select("code", "model", "column"), ["code", "model", "column"], "left_anti")


def withheld_cells(tables: dict[str, DataFrame], declared: DataFrame, restricted: Sequence[str], minimum: int = MIN_CELL) -> DataFrame:
    """(model, column, classification, rows, withheld): for each published column the filled values of its table, and how many of them the
    gate withholds, because the column's classification is restricted or missing or a count in its row is below the minimum."""
    parts = []
    for model, df in sorted(tables.items()):
        counts = [F.coalesce(F.col(c) < minimum, F.lit(False)) for c in df.columns if c in COUNT_FIELDS]
        small = reduce(Column.__or__, counts, F.lit(False))
        filled = [F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("filled")) for c in df.columns]
        long = df.select(small.alias("small"), F.explode(F.array(*filled)).alias("x")).where("x.filled").groupBy("x.column").agg(F.count("*").alias("rows"), F.count_if("small").alias("low"))
        parts.append(long.select(F.lit(model).alias("model"), "column", "rows", "low"))
    held = reduce(DataFrame.unionByName, parts).join(declared, ["model", "column"], "left")
    closed = F.col("classification").isNull() | F.col("classification").isin(*restricted)
    return held.select("model", "column", "classification", "rows", F.when(closed, F.col("rows")).otherwise(F.col("low")).alias("withheld"))


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([(m, c) for m, df in tables.items() for c in df.columns], "model string, column string")


def schema_drift(df: DataFrame, declared: dict[str, str], allowed: Sequence[str]) -> list[tuple[str, str]]:
    """Columns without a declaration or with one that isn't allowed; looks at the schema alone."""
    return [(c, "missing" if c not in declared else "invalid") for c in df.columns if declared.get(c) not in allowed]


def retention(df: DataFrame, created: str, as_of: datetime, days: int) -> DataFrame:
    """Add expired: more whole days than allowed have gone by. as_of must carry a time zone."""
    if as_of.tzinfo is None or days < 1:
        raise ValueError("as_of needs a time zone and days must be at least 1")
    age = F.floor((F.lit(int(as_of.timestamp())) - F.unix_timestamp(F.col(created).cast("timestamp"))) / 86400)
    return df.withColumn("expired", age > days)


def subject_export(tables: dict[str, DataFrame], keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All rows of the keys in every table that has the key column, and the audit: counts by table."""
    keys = broadcast_within(keys)
    found = {n: t.join(keys, SUBJECT_KEY, "left_semi") for n, t in sorted(tables.items()) if SUBJECT_KEY in t.columns}
    return found, _audit("export", found)


def subject_delete(tables: dict[str, DataFrame], keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the keys' rows; rows with a null key and tables without the key column stay as they are."""
    keys = broadcast_within(keys)
    kept = {n: t.join(keys, SUBJECT_KEY, "left_anti") if SUBJECT_KEY in t.columns else t for n, t in sorted(tables.items())}
    gone, _ = subject_export(tables, keys)
    return kept, _audit("delete", gone)


def files_with(spark: SparkSession, path: str, key: str, keys: DataFrame) -> list[str]:
    """The data files of a Parquet table that hold a row of the keys: one pass over the key column, a row for each file."""
    rows = spark.read.parquet(path).select(key, F.col("_metadata.file_path").alias("file"))
    own = broadcast_within(keys)
    return sorted(r["file"] for r in rows.join(own, key, "left_semi").select("file").distinct().collect())


def delete_from_files(spark: SparkSession, path: str, key: str, keys: DataFrame) -> tuple[int, int]:
    """Delete the keys' rows from a Parquet table in place; (files rewritten, files left byte for byte).

    Only files that hold a key are rewritten. Their other rows go to a hidden folder beside the data with a list of what they replace; then the old
    files go and the new ones take their place. If that is cut short, finish_deletion does the rest; until the list is written the table is as before. Rows with a null
    key stay. Partition columns aren't supported: the table is one folder.
    """
    finish_deletion(spark, path)
    touched = files_with(spark, path, key, keys)
    total = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct().count()
    if touched:
        schema = spark.read.parquet(path).schema
        staged = f"{path.rstrip('/')}/_deletion"
        spark.read.schema(schema).parquet(*touched).join(broadcast_within(keys), key, "left_anti").write.mode("overwrite").parquet(staged)
        spark.createDataFrame([(f,) for f in touched], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/_replaced")
        finish_deletion(spark, path)
    return len(touched), total - len(touched)


def finish_deletion(spark: SparkSession, path: str) -> None:
    """Put a begun deletion's files in place of those that they replace; repeating it does no harm. Nothing to do without a list."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    root = of(path.rstrip("/"))
    fs = root.getFileSystem(conf)
    listed, staged = of(f"{root}/_replaced"), of(f"{root}/_deletion")
    if not fs.exists(of(f"{root}/_replaced/_SUCCESS")):
        return
    for line in spark.read.text(f"{root}/_replaced").collect():  # names of files
        fs.delete(of(jvm.java.net.URI(line["value"])), False)
    if fs.exists(staged):
        for status in fs.listStatus(staged):
            if status.getPath().getName().startswith("part-"):
                fs.rename(status.getPath(), of(f"{root}/{status.getPath().getName()}"))
        fs.delete(staged, True)
    fs.delete(listed, True)


def _audit(action: str, tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count("*").alias("records")).select(F.lit(action).alias("action"), F.lit(n).alias("table_name"), "records") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts).where("records > 0")


def reconcile(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """Counts and loan sums of a slice against contracts (name, expected_count, expected_sum, tolerance_count, tolerance_sum)."""
    got = rows.agg(F.count("*").alias("actual_count"), F.coalesce(F.sum("loan_amount"), F.lit(0.0)).alias("actual_sum"))
    j = contracts.crossJoin(got)  # got: one row
    dc, ds = F.col("actual_count") - F.col("expected_count"), F.col("actual_sum") - F.col("expected_sum")
    return j.select("name", "actual_count", "actual_sum", dc.alias("count_difference"), ds.alias("sum_difference"), ((F.abs(dc) <= F.col("tolerance_count")) & (F.abs(ds) <= F.col("tolerance_sum"))).alias("passed"))


def scope_check(app: DataFrame, classes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Universe rows and rows inside classes by cohort and by null per field; in scope if no filter came between them."""
    by = lambda df, n: df.groupBy("derived_race", "derived_ethnicity").agg(n.alias("n"), *[F.sum(F.when(F.col(f).isNull(), F.lit(1) if "k" not in df.columns else F.col("k")).otherwise(0)).alias(f"null_{f}") for f in fields])
    a = by(app, F.count("*"))
    b = by(classes, F.sum("k"))
    b = b.toDF(*[f"b_{c}" for c in b.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in a.columns[2:]])
    j = a.join(b, F.col("derived_race").eqNullSafe(F.col("b_derived_race")) & F.col("derived_ethnicity").eqNullSafe(F.col("b_derived_ethnicity")), "full")
    return j.select(F.coalesce("derived_race", "b_derived_race").alias("derived_race"), F.coalesce("derived_ethnicity", "b_derived_ethnicity").alias("derived_ethnicity"), F.col("n").alias("universe_records"), F.col("b_n").alias("class_records"), F.coalesce(same, F.lit(False)).alias("in_scope"))
