"""l-diversity and t-closeness, uniqueness by group size, size-matched tracts, common support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.classes import guard, share
from riskspark.config import BLACK, DEMO_GEO, MIN_CELL, NON_HISPANIC, WHITE

MISSING = "<MISSING>"


def class_diversity(df: DataFrame, fields: Sequence[str], sensitive: str, minimum: int = MIN_CELL) -> DataFrame:
    """Per class: k, distinct values (null counts) and total variation from the overall distribution.

    A value that a class lacks adds its overall share, so the sum over all values is closed over the values present.
    """
    guard(df, [*fields, sensitive])
    n = df.groupBy(*fields, sensitive).agg(F.count("*").alias("n"))
    overall = n.groupBy(sensitive).agg(F.sum("n").alias("g"))
    overall = overall.select(F.col(sensitive).alias("_v"), (F.col("g").cast("double") / F.sum("g").over(Window.partitionBy())).alias("g"))  # one row a value
    joined = n.withColumn("k", F.sum("n").over(Window.partitionBy(*fields))).join(overall, F.col(sensitive).eqNullSafe(F.col("_v")))
    p = F.col("n").cast("double") / F.col("k")
    t = F.lit(0.5) * (F.sum(F.abs(p - F.col("g"))) + (1 - F.sum("g")))
    return joined.groupBy(*fields).agg(F.max("k").alias("k"), F.count("*").alias("l_distinct"), F.round(t, 9).alias("t_total_variation")).where(F.col("k") >= minimum)


def diversity_summary(classes: DataFrame, l_threshold: int = 2, t_threshold: float = 0.2) -> DataFrame:
    if not 0 <= t_threshold <= 1:
        raise ValueError("t_threshold must lie between 0 and 1")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("k")).otherwise(0)), F.lit(0).cast("long"))
    n, low, far = F.coalesce(F.sum("k"), F.lit(0).cast("long")), part(F.col("l_distinct") < l_threshold), part(F.col("t_total_variation") > t_threshold)
    return classes.agg(n.alias("records"), F.lit(l_threshold).alias("l_threshold"), F.lit(float(t_threshold)).alias("t_threshold"), low.alias("records_failing_l"), far.alias("records_failing_t"), F.coalesce(share(low, n), F.lit(0.0)).alias("share_failing_l"), F.coalesce(share(far, n), F.lit(0.0)).alias("share_failing_t"))


def score_demographic(df: DataFrame) -> DataFrame:
    """Classes over tract, age, sex, race and ethnicity with their records k, and n_group, the records of the tract, race and ethnicity; nulls are one
    literal value. Records are counted before they are dealt, and a group's window holds a row for each age and sex, whatever its records."""
    keys = ("census_tract", "derived_race", "derived_ethnicity")
    clean = df.select(*[F.coalesce(c, F.lit(MISSING)).alias(c) for c in DEMO_GEO]).groupBy(*DEMO_GEO).agg(F.count("*").alias("k"))
    return clean.withColumn("n_group", F.sum("k").over(Window.partitionBy(*keys))).withColumn("is_unique", F.col("k") == 1)


def focal(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("derived_race").isin(BLACK, WHITE) & (F.col("derived_ethnicity") == NON_HISPANIC))


# Fixed upper ends and labels of the group-size bins.
BINS = ((1, "1"), (2, "2"), (4, "3-4"), (9, "5-9"), (19, "10-19"), (49, "20-49"), (99, "50-99"))


def by_group_size(scored: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Uniqueness by bin of group size and race, and over all bins; bins below the minimum are left out."""
    bin_ = F.lit("100+")
    for top, label in reversed(BINS):
        bin_ = F.when(F.col("n_group") <= top, label).otherwise(bin_)
    one = F.sum(F.col("is_unique").cast("long"))
    rows = focal(scored).withColumn("group_size_bin", bin_)
    keys = [F.col("group_size_bin"), F.col("derived_race")]
    out = rows.groupingSets([keys, keys[1:]], *keys).agg(F.grouping("group_size_bin").alias("all"), F.sum("k").alias("record_count"), one.alias("unique_records"), share(one, F.sum("k")).alias("sample_uniqueness_rate"))
    return out.where(F.col("record_count") >= minimum).select(F.when(F.col("all") == 1, "overall").otherwise(F.col("group_size_bin")).alias("group_size_bin"), "derived_race", "record_count", "unique_records", "sample_uniqueness_rate")


def matched_tracts(scored: DataFrame, tolerance: float = 1.2) -> DataFrame:
    """Tracts where both cohorts are present with sizes within the tolerance: sizes and uniques (nb, nw, ub, uw)."""
    of = lambda race, v: F.sum(F.when(F.col("derived_race") == race, v).otherwise(0))
    u = F.col("is_unique").cast("long")
    t = focal(scored).groupBy("census_tract").agg(of(BLACK, F.col("k")).alias("nb"), of(WHITE, F.col("k")).alias("nw"), of(BLACK, u).alias("ub"), of(WHITE, u).alias("uw"))
    return t.where((F.col("nb") > 0) & (F.col("nw") > 0) & (F.greatest("nb", "nw") / F.least("nb", "nw") <= tolerance))


def size_matched_ratio(tracts: DataFrame, tolerance: float = 1.2) -> DataFrame:
    s = tracts.agg(F.count("*").alias("matched_tracts"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("nb", "nw", "ub", "uw")])
    black, white = share(F.col("ub"), F.col("nb")), share(F.col("uw"), F.col("nw"))
    return s.select(F.lit(tolerance).alias("matching_tolerance_ratio"), "matched_tracts", F.col("nb").alias("black_records"), F.col("nw").alias("white_records"), black.alias("black_uniqueness"), white.alias("white_uniqueness"), F.round(black / F.nullif(white, F.lit(0.0)), 9).alias("uniqueness_ratio"), ((F.col("matched_tracts") < 20) | (F.col("nb") < 100) | (F.col("nw") < 100)).alias("underpowered"))


def common_support(rows: DataFrame, by: Sequence[str] = ("configuration",)) -> DataFrame:
    """Share of each group's records in covariate cells that hold both groups; nulls are a value. A column n counts records."""
    fields = [c for c in rows.columns if c not in (*by, "is_black", "is_denied", "n")]
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    cells = rows.groupBy(*by, *fields).agg(F.sum((1 - F.col("is_black")) * n).alias("n0"), F.sum(F.col("is_black") * n).alias("n1"))
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    part = lambda c: share(F.sum(F.when(both, F.col(c)).otherwise(0)), F.sum(c))
    return cells.groupBy(*by).agg(part("n0").alias("common_support_reference_share"), part("n1").alias("common_support_comparison_share"))
