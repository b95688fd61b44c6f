"""Equivalence classes, their sizes, and disclosure risk by cohort. Classes are formed on the complete frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.config import FORBIDDEN, MIN_CELL, TIERS, UNIVERSES


def guard(df: DataFrame, fields: Sequence[str], forbidden: Sequence[str] = FORBIDDEN) -> None:
    """Raise if a quasi-identifier is missing or a direct identifier is present; looks at the schema alone."""
    if missing := [f for f in fields if f not in df.columns]:
        raise ValueError(f"missing quasi-identifiers: {missing}")
    if found := [f for f in forbidden if f in df.columns]:
        raise ValueError(f"direct identifiers must not be present: {found}")


def equivalence_classes(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row for each combination of the fields, with its size k; nulls are equal."""
    guard(df, fields)
    return df.groupBy(*fields).agg(F.count("*").alias("k"))


def score_k(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Attach the size of its class to every record: a window instead of a null-safe join back."""
    guard(df, fields)
    return df.withColumn("k", F.count("*").over(Window.partitionBy(*fields)))


def tier_profiles(df: DataFrame, tiers: dict[str, Sequence[str]] = TIERS) -> dict[str, DataFrame]:
    """Classes of nested tiers: records are counted by the most fields, whose classes the coarser tiers add up, so tasks sum before every exchange and
    no class of many records is dealt row by row. Spark reuses the first exchange."""
    out: dict[str, DataFrame] = {}
    finest = None
    for name, fields in sorted(tiers.items(), key=lambda t: -len(t[1])):
        guard(df, fields)
        nested = finest is not None and set(fields) <= set(finest.columns)
        out[name] = finest.groupBy(*fields).agg(F.sum("k").alias("k")) if nested else equivalence_classes(df, fields)
        finest = out[name] if finest is None else finest
    return {name: out[name] for name in tiers}


def share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def _upto(n: int) -> Column:
    return F.sum(F.when(F.col("k") < n, F.col("k")).otherwise(0))


def risk_summary(classes: DataFrame) -> DataFrame:
    """One row: records, classes, uniques, shares under 5 and 10 and prosecutor risk; 0 for an empty universe."""
    n = F.sum("k")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rate = lambda c: F.coalesce(share(c, n), F.lit(0.0))
    return classes.agg(
        zero(n).alias("record_count"), F.count("*").alias("equivalence_classes"), zero(_upto(2)).alias("sample_unique_records"), rate(_upto(2)).alias("sample_uniqueness_rate"),
        zero(_upto(5)).alias("records_k_lt_5"), zero(_upto(10)).alias("records_k_lt_10"), rate(F.count("*")).alias("prosecutor_expected_match_risk"),
    )


def k_distribution(classes: DataFrame) -> DataFrame:
    return classes.groupBy("k").agg(F.count("*").alias("classes"), F.sum("k").alias("records"))


def publishable(table: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """A table without its rows of fewer records than the minimum."""
    return table.where(F.col("record_count") >= minimum)


def class_risk(classes: DataFrame, by: Sequence[str], minimum: int = MIN_CELL, with_ten: bool = True) -> DataFrame:
    """Risk by cohort columns that are quasi-identifiers themselves: sums over classes, no join back to records."""
    n = F.sum("k")
    ten = [share(_upto(10), n).alias("share_records_k_lt_10")] if with_ten else []
    out = classes.groupBy(*by).agg(n.alias("record_count"), share(_upto(2), n).alias("sample_uniqueness_rate"), share(_upto(5), n).alias("share_records_k_lt_5"), *ten, share(F.count("*"), n).alias("prosecutor_expected_match_risk"))
    return publishable(out, minimum)


def cohort_risk(df: DataFrame, fields: Sequence[str], cohort: Sequence[str], minimum: int = MIN_CELL) -> DataFrame:
    """Risk by any cohort columns: counts by class and cohort, k as their sum over the class, then sums by cohort."""
    guard(df, [*fields, *cohort])
    extra = [c for c in cohort if c not in fields]
    cells = df.groupBy(*fields, *extra).agg(F.count("*").alias("n"))
    cells = cells.withColumn("k", F.sum("n").over(Window.partitionBy(*fields)))
    out = cells.groupBy(*cohort).agg(
        F.sum("n").alias("record_count"), share(F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)), F.sum("n")).alias("sample_uniqueness_rate"),
        F.round(F.sum(F.col("n").cast("double") / F.col("k")) / F.sum("n"), 9).alias("mean_match_risk"),
    )
    return publishable(out, minimum)


def cohort_risk_report(df: DataFrame, fields: Sequence[str], cohort: Sequence[str], universe: str, minimum: int = MIN_CELL) -> DataFrame:
    """One row of metadata for a cohort report."""
    if universe not in UNIVERSES:
        raise ValueError(f"unknown equivalence universe: {universe}")
    published = cohort_risk(df, fields, cohort, minimum).agg(F.count("*").alias("published_cohorts"))
    source = df.agg(F.count("*").alias("source_records"))
    return source.crossJoin(published).select(F.lit(universe).alias("equivalence_universe"), F.lit(",".join(cohort)).alias("cohort_fields"), "source_records", "published_cohorts", F.lit(minimum).cast("long").alias("minimum_cell_size"), F.lit(True).alias("aggregate_only"))


def cohort_counts(app: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    out = app.groupBy("activity_year", "derived_race", "derived_ethnicity").agg(F.count("*").alias("record_count"), share(F.sum(F.col("is_denied").cast("long")), F.count("is_denied")).alias("denial_rate"))
    return publishable(out, minimum)


def tier_sensitivity(df: DataFrame, by: Sequence[str], minimum: int) -> DataFrame:
    parts = [class_risk(c, by, minimum, with_ten=False).withColumn("qi_tier", F.lit(name)) for name, c in tier_profiles(df).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
