"""Tract context, density quintiles and risk by density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.classes import equivalence_classes, publishable, share
from riskspark.config import DEMO_GEO, MIN_CELL
from riskspark.ranking import exact_percentile, ntile
from riskspark.shared import broadcast_within


def tract_population(raw: DataFrame) -> DataFrame:
    """Exact median population of each tract."""
    rows = raw.select("census_tract", F.col("tract_population").try_cast("double").alias("p")).where("census_tract is not null and p is not null")
    return exact_percentile(rows, ["census_tract"], "p", 0.5, "population")


def population_conflicts(raw: DataFrame) -> DataFrame:
    rows = raw.select("census_tract", F.col("tract_population").try_cast("double").alias("p")).where("census_tract is not null and p is not null")
    many = rows.groupBy("census_tract").agg(F.count_distinct("p").alias("values"))
    return many.agg(F.count("*").alias("tracts"), F.count_if(F.col("values") > 1).alias("conflicting_tracts"))


def gazetteer(raw: DataFrame) -> DataFrame:
    """A land-area table for the tracts of the fixture; tracts that end in 002000 are left out on purpose."""
    t = raw.where("census_tract is not null and substring(census_tract, 6, 6) <> '002000'").select("census_tract").distinct()
    area = F.lit(0.5) + (F.substring("census_tract", 6, 6).cast("int") / F.lit(100) * 7 + F.substring("census_tract", 3, 3).cast("int")) % 40
    return t.select(F.substring("census_tract", 1, 2).alias("usps"), F.col("census_tract").alias("geoid"), area.cast("string").alias("aland_sqmi"))


def read_gazetteer(spark, path: str, state: str | None = None) -> DataFrame:
    """Tab-separated text, of one state or all; header names and values may carry spaces."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    df = df if state is None else df.where(F.trim("usps") == state)
    return df.select(F.trim("usps").alias("usps"), F.trim("geoid").alias("geoid"), F.trim("aland_sqmi").alias("aland_sqmi"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row holds, with their number of rows: empty where a join needs a one side. Nulls are a value."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if no two rows share the keys; otherwise an error that names one of them. Runs a job."""
    if found := repeated_keys(df, keys).first():
        raise ValueError(f"more than one row for {[found[k] for k in keys]}")
    return df


def tract_context(population: DataFrame, gaz: DataFrame) -> DataFrame:
    """Population, land area and density; one row a tract on both sides (require_unique tells). Tracts without land are out."""
    land = gaz.select(F.trim("geoid").alias("census_tract"), F.col("aland_sqmi").try_cast("double").alias("land_area_sqmi"))
    both = population.join(land, "census_tract").where("population >= 0 and land_area_sqmi > 0")
    return both.select("census_tract", F.col("population").cast("long").alias("population"), "land_area_sqmi", F.round(F.col("population") / F.col("land_area_sqmi"), 9).alias("population_density_per_sqmi"))


def release_density(app: DataFrame, records: Column | None = None) -> DataFrame:
    """Quintiles of tracts by applications, ties by tract; ranked over ranges of tracts. records: the column with a row's number of applications, where it isn't one."""
    counts = app.where("census_tract is not null").groupBy("census_tract").agg((F.count("*") if records is None else F.sum(records)).alias("application_count"))
    return ntile(counts, 5, ["application_count", "census_tract"], "release_density_quintile")


def residential_density(context: DataFrame) -> DataFrame:
    valid = context.where("population_density_per_sqmi is not null and population_density_per_sqmi >= 0")
    return ntile(valid, 5, ["population_density_per_sqmi", "census_tract"], "residential_density_quintile")


def _record_risk() -> list[Column]:
    """Risk of records from their classes: k records of risk 1/k each make one a class."""
    n = F.sum("k")
    return [n.alias("record_count"), share(F.count_if(F.col("k") == 1), n).alias("sample_uniqueness_rate"), F.round(share(F.count("*"), n), 9).alias("prosecutor_expected_match_risk")]


def risk_by_release(app: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    return release_risk(equivalence_classes(app, DEMO_GEO), release_density(app), minimum)


def release_risk(classes: DataFrame, density: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    joined = classes.join(broadcast_within(density), "census_tract")
    n = F.sum("k")
    out = joined.groupBy("release_density_quintile", "derived_race", "derived_ethnicity").agg(n.alias("record_count"), share(F.sum(F.when(F.col("k") == 1, 1).otherwise(0)), n).alias("sample_uniqueness_rate"), share(F.count("*"), n).alias("prosecutor_expected_match_risk"))
    return publishable(out, minimum)


def release_overall(by_cell: DataFrame) -> DataFrame:
    """Record-weighted means of the published cells of a quintile."""
    w = lambda c: F.round(F.sum(F.col(c) * F.col("record_count")) / F.sum("record_count"), 9)
    return by_cell.groupBy("release_density_quintile").agg(F.sum("record_count").alias("record_count"), w("sample_uniqueness_rate").alias("sample_uniqueness_rate"), w("prosecutor_expected_match_risk").alias("prosecutor_expected_match_risk"))


def risk_by_residential(app: DataFrame, context: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    return residential_risk(equivalence_classes(app, DEMO_GEO), context, minimum)


def residential_risk(classes: DataFrame, context: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Cohorts and, as ALL, whole quintiles, in one pass of grouping sets."""
    q = broadcast_within(residential_density(context).select("census_tract", "residential_density_quintile"))
    scored = classes.join(q, "census_tract")
    keys = [F.col("residential_density_quintile"), F.col("derived_race"), F.col("derived_ethnicity")]
    out = publishable(scored.groupingSets([keys, keys[:1]], *keys).agg(F.grouping_id().alias("gid"), *_record_risk()), minimum)
    label = lambda c: F.when(F.col("gid") > 0, "ALL").otherwise(F.col(c)).alias(c)
    return out.select("residential_density_quintile", label("derived_race"), label("derived_ethnicity"), "record_count", "sample_uniqueness_rate", "prosecutor_expected_match_risk")


def risk_by_cross(app: DataFrame, context: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    a = broadcast_within(residential_density(context).select("census_tract", "residential_density_quintile"))
    b = broadcast_within(release_density(app).select("census_tract", "release_density_quintile"))
    out = equivalence_classes(app, DEMO_GEO).join(a, "census_tract").join(b, "census_tract").groupBy("residential_density_quintile", "release_density_quintile").agg(*_record_risk())
    return out.where(F.col("record_count") >= minimum)


def association(app: DataFrame, context: DataFrame) -> DataFrame:
    both = residential_density(context).join(release_density(app), "census_tract")
    return both.agg(F.round(F.corr("residential_density_quintile", "release_density_quintile"), 9).alias("quintile_correlation"), F.count("*").alias("matched_tracts"))


AUDIT = {"derived_race": "derived_race", "derived_ethnicity": "derived_ethnicity", "action_taken": "cast(action_taken as string)", "derived_dwelling_category": "derived_dwelling_category", "lei": "lei"}


def exclusion_audit(app: DataFrame, context: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Records kept and dropped by the density join, by five dimensions, in one pass."""
    tracts = broadcast_within(residential_density(context).select("census_tract", F.lit(True).alias("matched")))
    joined = app.join(tracts, "census_tract", "left").withColumn("join_status", F.when(F.col("matched"), "retained").otherwise("dropped"))
    stack = ", ".join(f"'{k}', {v}" for k, v in AUDIT.items())
    long = joined.select("join_status", F.expr(f"stack({len(AUDIT)}, {stack}) as (dimension, category)"))
    return long.groupBy("dimension", "category", "join_status").agg(F.count("*").alias("record_count")).where(F.col("record_count") >= minimum)


CONTEXT_TYPES = {"census_tract": "string", "population": "bigint", "land_area_sqmi": "double", "population_density_per_sqmi": "double"}


def read_context(spark, path: str) -> DataFrame:
    """Tract context from CSV with a header: read as text, then typed; what isn't a number is null."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in CONTEXT_TYPES)).option("header", True).csv(path)
    return raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in CONTEXT_TYPES.items()])
