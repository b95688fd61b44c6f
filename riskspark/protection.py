"""Generalization, suppression, and the privacy-utility frontier."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.classes import equivalence_classes, score_k, share
from riskspark.config import BLACK, DECISIONS, DENIALS, INSTITUTION, MIN_CELL, NON_HISPANIC, PROTECTIONS, UNSUPPRESSED, WHITE, ProtectionConfig
from riskspark.lar import Coded
from riskspark.shared import small_table

PREFIX = {"tract": 11, "county": 5, "state": 2}
#: z(1 - alpha/2) + z(power) for alpha 0.05 and power 0.8.
Z_SUM = 2.801585


def z_sum(alpha: float = 0.05, power: float = 0.8) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)


def generalize_geography(tract: Column, level: str) -> Column:
    """An 11-digit tract to its county, state or the nation; a trailing .0 goes, short codes are padded, null stays null."""
    if level == "national":
        return F.when(tract.isNotNull(), "US")
    if level not in PREFIX:
        raise ValueError(f"unsupported geography: {level}")
    code = F.regexp_replace(F.trim(tract), r"\.0$", "")
    code = F.when(F.length(code) < 11, F.lpad(code, 11, "0")).otherwise(code)
    return code if level == "tract" else F.substring(code, 1, PREFIX[level])


def band_label(x: Column, width: float | None) -> Column:
    """"low-high" of the band that holds x; without a width the number itself."""
    if width is None:
        return x.try_cast("double")
    if width <= 0:
        raise ValueError("band widths must be positive")
    low = F.floor(x.try_cast("double") / width) * F.lit(width)
    return F.concat(low.cast("long").cast("string"), F.lit("-"), (low + F.lit(width)).cast("long").cast("string"))


def protected(app: DataFrame, p: ProtectionConfig) -> DataFrame:
    """Protected columns in place; tract prefixes without padding, numbers by the low end of their band."""
    out = app if p.geography == "tract" else app.withColumn("census_tract", F.when(F.col("census_tract").isNotNull(), "US") if p.geography == "national" else F.substring("census_tract", 1, PREFIX[p.geography]))
    return out.withColumns({c: F.floor(F.col(c) / w).cast("double") * F.lit(float(w)) for c, w in p.bands.items()})


def apply_protection(df: DataFrame, p: ProtectionConfig, fields: Sequence[str] = INSTITUTION) -> DataFrame:
    """Generalize and keep records of classes of suppress_k_below or more; only fields among the quasi-identifiers change."""
    out = df
    if "census_tract" in fields:
        out = out.withColumn("census_tract", generalize_geography(F.col("census_tract"), p.geography))
    for c, w in p.bands.items():
        out = out.withColumn(c, band_label(F.col(c), w)) if c in fields else out
    if p.suppress_k_below is None:
        return out
    # the classes to suppress hold few records each, so no key of theirs is hot; the others' rows can be split in the join
    small = equivalence_classes(out, fields).where(F.col("k") < p.suppress_k_below).select(*[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)])
    return out.join(small, reduce(Column.__and__, [F.col(f).eqNullSafe(F.col(f"_{i}")) for i, f in enumerate(fields)]), "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


LEVELS = ("tract", "county", "state", "national")


def nests(inner: ProtectionConfig, outer: ProtectionConfig) -> bool:
    """Whether what inner leaves is enough to make outer: geography as coarse or coarser, bands a multiple or none."""
    bands = all(b is not None and b % a == 0 for c, a in inner.bands.items() for b in (outer.bands.get(c),))
    return LEVELS.index(inner.geography) <= LEVELS.index(outer.geography) and bands


def counted(app: DataFrame, fields: Sequence[str] = INSTITUTION, actions: Sequence[int | None] | None = None) -> tuple[DataFrame, dict[object, str]]:
    """(classes of the fields with their size k and a count for each action; the actions' columns). The actions of the table are looked up first unless given."""
    found = [r[0] for r in app.select("action_taken").distinct().collect()] if actions is None else actions  # the register's few codes
    actions = sorted(found, key=lambda a: (a is None, a))
    names = {a: f"n_{i}" for i, a in enumerate(actions)}
    return app.groupBy(*fields).agg(F.count("*").alias("k"), *[F.count_if(F.col("action_taken").eqNullSafe(F.lit(a))).alias(c) for a, c in names.items()]), names


@dataclass(frozen=True)
class Classes:
    """Coded records' classes by all their fields, with their size k and a count for each action; the counts' columns by action."""

    of: Coded
    rows: DataFrame
    names: dict[object, str]


@dataclass(frozen=True)
class Sizes:
    """Classes added up by configuration, race, ethnicity and size k, with a count for each action; the counts' columns by action."""

    rows: DataFrame
    names: dict[object, str]


def _keys(of: Coded, fields: Sequence[str]) -> list[str]:
    keys = [*[f for f in fields if f not in of.vocabularies], "profile"]
    if missing := [f for f in (*fields, *of.vocabularies) if (f not in of.vocabularies and f not in of.rows.columns) or f not in fields]:
        raise ValueError(f"coded records have classes of all their fields alone: {missing}")
    return keys


def coded_classes(app: Coded, fields: Sequence[str] = INSTITUTION) -> Classes:
    """The classes of coded records, which all else is rolled up from; large tables are dealt to more tasks first."""
    keys = _keys(app, fields)
    return Classes(app, *counted(app.dealt(app.rows, *keys), keys, app.actions))


def rolled(app: DataFrame | Coded | Classes, configs: Sequence[ProtectionConfig], fields: Sequence[str] = INSTITUTION, keep: Sequence[str] = ()) -> tuple[list[tuple[ProtectionConfig, DataFrame]], dict[object, str]]:
    """Classes of protected fields with their size k and a count for each action, for each configuration; the counts' columns by action.

    Counting actions in columns gives a class's size in the same sums, so no window is needed and a configuration costs one exchange, of sums that
    tasks have made before; it starts from the last configuration that nests in it, whose exchange Spark reuses, and only the first
    reads records. Coded records are summed by their profile, which is unpacked in what is returned, but for the fields to keep; large tables of
    them are dealt to more tasks first, so that a task's classes don't grow with the table.
    """
    if isinstance(app, Coded):
        app = coded_classes(app, fields)
    if isinstance(app, Classes):
        of, keys = app.of, _keys(app.of, fields)
        classes = _rolled(app.rows, configs, keys, app.names, lambda df: of.dealt(df, *keys))
        return [(p, of.unpacked(n, keep)) for p, n in classes], app.names
    records, names = counted(app, fields)
    return _rolled(records, configs, fields, names), names


def _rolled(records: DataFrame, configs: Sequence[ProtectionConfig], fields: Sequence[str], names: dict[object, str], deal: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[tuple[ProtectionConfig, DataFrame]]:
    done = [(ProtectionConfig("records"), records)]
    out = []
    for p in configs:
        of, n = next((q, d) for q, d in reversed(done) if nests(q, p))
        if (of.geography, of.bands) != (p.geography, p.bands):
            n = deal(protected(n, p)).groupBy(*fields).agg(*[F.sum(c).alias(c) for c in ("k", *names.values())])
        done.append((p, n))
        out.append((p, n))
    return out


def _by_action(names: dict[object, str]) -> Column:
    """Rows (action_taken, record_count) of a row's counts, without empty ones."""
    return F.explode(F.filter(F.array(*[F.struct(F.lit(a).cast("int").alias("action_taken"), F.col(c).alias("record_count")) for a, c in names.items()]), lambda x: x["record_count"] > 0))


def _sum_of(names: dict[object, str], actions: Sequence[int]) -> Column:
    return reduce(Column.__add__, [F.col(c) for a, c in names.items() if a in actions], F.lit(0).cast("long"))


def protection_classes(app: DataFrame | Coded, configs: Sequence[ProtectionConfig] = PROTECTIONS, fields: Sequence[str] = INSTITUTION) -> DataFrame:
    """(configuration, derived_race, derived_ethnicity, k), a row for each class."""
    return _union([n.select(F.lit(p.name).alias("configuration"), "derived_race", "derived_ethnicity", "k") for p, n in rolled(app, configs, fields)[0]])


def cohort_sizes(app: DataFrame | Coded | Classes, configs: Sequence[ProtectionConfig] = PROTECTIONS, fields: Sequence[str] = INSTITUTION) -> Sizes:
    """The classes of every configuration added up by cohort and size, in one pass over them."""
    parts, names = rolled(app, configs, fields)
    cells = _union([n.select(F.lit(p.name).alias("configuration"), "derived_race", "derived_ethnicity", "k", *names.values()) for p, n in parts])
    return Sizes(cells.groupBy("configuration", "derived_race", "derived_ethnicity", "k").agg(*[F.sum(c).alias(c) for c in names.values()]), names)


def protection_cells(app: DataFrame | Coded | Classes | Sizes, configs: Sequence[ProtectionConfig] = PROTECTIONS, fields: Sequence[str] = INSTITUTION) -> DataFrame:
    """Records by configuration, cohort, action and class size."""
    sizes = app if isinstance(app, Sizes) else cohort_sizes(app, configs, fields)
    cells, names = sizes.rows, sizes.names
    return cells.select("configuration", "derived_race", "derived_ethnicity", "k", _by_action(names).alias("a")).select("configuration", "derived_race", "derived_ethnicity", "a.action_taken", "k", "a.record_count")


def mde_points(n1: Column, n2: Column, p: Column, z: float = Z_SUM) -> Column:
    """Smallest detectable difference of two shares, in points; null without two records a side or for shares of 0 and 1."""
    ok = (n1 >= 2) & (n2 >= 2) & (p > 0) & (p < 1)
    return F.when(ok, F.lit(100.0) * F.lit(z) * F.sqrt(p * (1 - p) * (F.lit(1.0) / n1 + F.lit(1.0) / n2)))


def _cond(where: Column, value: Column | None = None) -> Column:
    return F.sum(F.when(where, F.lit(1) if value is None else value).otherwise(0))


def frontier(cells: DataFrame, base: str = "cfpb_current", k_min: int = 5, minimum: int = MIN_CELL) -> DataFrame:
    """Privacy and utility of each suppressed configuration and of the unsuppressed base, the only current baseline.

    Of the records in classes of k there are k for each class, so classes are counted from the cells, which are written once.
    """
    cells = small_table(cells, "protection-cells")  # read twice
    sized = cells.groupBy("configuration", "k").agg(F.sum("record_count").alias("r"))
    n = F.sum("r")
    risk = sized.groupBy("configuration").agg(n.alias("record_count"), share(_cond(F.col("k") == 1, F.col("r")), n).alias("pre_suppression_uniqueness_rate"), share(F.sum(F.expr("r div k")), n).alias("pre_suppression_prosecutor_risk"), share(_cond(F.col("k") >= k_min, F.col("r")), n).alias("retained_share"))
    held = risk.select("*", F.lit(False).alias("is_current_baseline"), F.col("configuration").alias("of"), F.lit(0.0).alias("post_suppression_uniqueness_rate"))
    now = risk.where(F.col("configuration") == base).select(F.lit(UNSUPPRESSED.name).alias("configuration"), "record_count", "pre_suppression_uniqueness_rate", "pre_suppression_prosecutor_risk", F.lit(1.0).alias("retained_share"), F.lit(True).alias("is_current_baseline"), F.col("configuration").alias("of"), F.col("pre_suppression_uniqueness_rate").alias("post_suppression_uniqueness_rate"))
    states = held.unionByName(now)
    cohort = cells.where((F.col("derived_ethnicity") == NON_HISPANIC) & F.col("derived_race").isin(WHITE, BLACK) & F.col("action_taken").isin(*DECISIONS))
    cohort = cohort.withColumnRenamed("configuration", "of").withColumnRenamed("record_count", "n")
    pairs = cohort.join(F.broadcast(states.select("of", "configuration", "is_current_baseline")), "of").where(F.col("is_current_baseline") | (F.col("k") >= k_min))
    white, black = F.col("derived_race") == WHITE, F.col("derived_race") == BLACK
    use = pairs.groupBy("configuration").agg(_cond(white, F.col("n")).alias("reference_n"), _cond(black, F.col("n")).alias("comparison_n"), share(_cond(white & F.col("action_taken").isin(*DENIALS), F.col("n")), _cond(white, F.col("n"))).alias("reference_denial_rate"))
    ok = (F.col("reference_n") >= minimum) & (F.col("comparison_n") >= minimum)
    p = F.col("reference_denial_rate")
    mde = F.when(ok, F.round(F.lit(100.0) * F.lit(Z_SUM) * F.sqrt(p * (1 - p) * (F.lit(1.0) / F.col("reference_n") + F.lit(1.0) / F.col("comparison_n"))), 9))
    return states.join(use, "configuration", "left").select(
        "configuration", "is_current_baseline", "record_count", "pre_suppression_uniqueness_rate", "pre_suppression_prosecutor_risk", "post_suppression_uniqueness_rate",
        (1 - F.col("retained_share")).alias("suppression_cost_share"), "retained_share", "reference_n", "comparison_n", ok.alias("utility_estimable"), "reference_denial_rate", mde.alias("minimum_detectable_disparity_points"),
    )


def frontier_report(published: DataFrame) -> DataFrame:
    """One row of metadata for the published frontier rows: what the utility figure is, how many rows there are and how many are redacted."""
    return published.agg(F.count("*").alias("rows"), F.count_if(F.col("suppression_status").isNotNull()).alias("redacted_rows")).select(
        F.lit(True).alias("aggregate_only"), F.lit(0.05).alias("alpha"), F.lit(0.8).alias("power"), F.lit("decision-only two-proportion MDE for each declared release state").alias("utility_metric"),
        F.lit("Adjusted fair-lending model remains required for final determination").alias("limitations"), "rows", "redacted_rows",
    )


def modeling_cohort(app: DataFrame, configs: Sequence[ProtectionConfig] = PROTECTIONS, fields: Sequence[str] = INSTITUTION) -> DataFrame:
    """Internal, row grain: decisions on the two focal cohorts in classes that survive suppression. Never published."""
    parts = []
    for p in configs:
        rows = score_k(protected(app, p), fields).where((F.col("k") >= (p.suppress_k_below or 1)) & F.col("derived_race").isin(WHITE, BLACK) & (F.col("derived_ethnicity") == NON_HISPANIC) & F.col("action_taken").isin(*DECISIONS))
        parts.append(rows.select(
            F.lit(p.name).alias("configuration"), (F.col("derived_race") == BLACK).cast("int").alias("is_black"), F.col("is_denied").cast("int").alias("is_denied"), F.col("census_tract").alias("protected_geography"),
            F.col("income").alias("protected_income"), F.col("loan_amount").alias("protected_loan_amount"), "applicant_age", "applicant_sex", "loan_type", "debt_to_income_ratio", "loan_purpose", "occupancy_type", "lien_status", "derived_dwelling_category",
        ))
    return _union(parts)


COVARIATES = ("applicant_age", "applicant_sex", "loan_type", "debt_to_income_ratio", "loan_purpose", "occupancy_type", "lien_status", "derived_dwelling_category")


#: Records that the modeling cohort is made of; a class holds such ones alone or none, as both fields stay as they are in every configuration.
FOCAL = {"derived_race": (WHITE, BLACK), "derived_ethnicity": (NON_HISPANIC,)}


def modeling_classes(app: DataFrame | Coded, configs: Sequence[ProtectionConfig] = PROTECTIONS, fields: Sequence[str] = INSTITUTION, packed: bool = False) -> DataFrame:
    """The modeling cohort by class: its columns and n, a class's records of either decision; cells of several institutions have several rows.
    packed: the closed vocabularies among coded records' covariates stay one number, `kept`. Internal as well."""
    if packed and not isinstance(app, Coded):
        raise ValueError("only coded records are packed")
    parts, names = rolled(app, configs, fields, COVARIATES if packed else ())
    rest = [F.col(c) for c in (["kept"] if packed else COVARIATES)]
    values = [F.col("census_tract").alias("protected_geography"), F.col("income").alias("protected_income"), F.col("loan_amount").alias("protected_loan_amount")]
    return _union([_decided(n, p, names, [*values, *rest]) for p, n in parts])


def _decided(classes: DataFrame, p: ProtectionConfig, names: dict[object, str], fields: Sequence[Column]) -> DataFrame:
    """The modeling cohort of a configuration's classes or of sums of classes alike in race, ethnicity and size: its codes, the fields and n."""
    cohort = F.col("derived_race").isin(WHITE, BLACK) & (F.col("derived_ethnicity") == NON_HISPANIC)
    keys = [F.lit(p.name).alias("configuration"), (F.col("derived_race") == BLACK).cast("int").alias("is_black")]
    sides = F.array(*[F.struct(F.lit(v).alias("is_denied"), n_.alias("n")) for v, n_ in ((1, _sum_of(names, DENIALS)), (0, _sum_of(names, [a for a in DECISIONS if a not in DENIALS])))])
    kept = classes.where((F.col("k") >= (p.suppress_k_below or 1)) & cohort).select(*keys, F.explode(sides).alias("s"), *fields)
    return kept.select("configuration", "is_black", "s.is_denied", *kept.columns[3:], "s.n").where("n > 0")


def by_covariates(app: DataFrame | Coded, rows: DataFrame) -> DataFrame:
    """Rows of the modeling cohort dealt by configuration and covariates, for sums by these or more, where the table needs more tasks than Spark takes."""
    return app.dealt(rows, *[c for c in rows.columns if c not in ("is_black", "is_denied", "n")]) if isinstance(app, Coded) else rows


def modeling_cells(app: DataFrame | Coded | Sizes, configs: Sequence[ProtectionConfig] = PROTECTIONS, fields: Sequence[str] = INSTITUTION) -> DataFrame:
    """The modeling cohort summed up: its columns and n, the records alike in all of them; of sizes, which lack the covariates, its configurations and codes alone.
    Internal as well."""
    if isinstance(app, Sizes):
        every = _union([_decided(app.rows.where(F.col("configuration") == p.name), p, app.names, []) for p in configs])
    else:
        every = by_covariates(app, modeling_classes(app, configs, fields))
    return every.groupBy(*[c for c in every.columns if c != "n"]).agg(F.sum("n").alias("n"))


def disparity_power(df: DataFrame, group: str = "derived_race", reference: str = WHITE, comparison: str = BLACK) -> DataFrame:
    """Sizes, reference denial rate and detectable difference of two groups; no restriction on actions or ethnicity."""
    a, b = F.col(group) == reference, F.col(group) == comparison
    out = df.agg(_cond(a).alias("reference_n"), _cond(b).alias("comparison_n"), share(_cond(a & F.col("action_taken").isin(*DENIALS)), _cond(a)).alias("reference_denial_rate"))
    return out.withColumn("minimum_detectable_disparity_points", F.round(mde_points(F.col("reference_n"), F.col("comparison_n"), F.col("reference_denial_rate")), 9))


def frontier_points(df: DataFrame | Coded, configs: Sequence[ProtectionConfig], baseline: str, fields: Sequence[str] = INSTITUTION) -> DataFrame:
    """Risk and power of what each configuration leaves, from the classes of all of them. Coded records hold clean tracts already."""
    if baseline not in [p.name for p in configs]:
        raise ValueError(f"no configuration is called {baseline}")
    clean = df.withColumn("census_tract", generalize_geography(F.col("census_tract"), "tract")) if "census_tract" in fields and not isinstance(df, Coded) else df
    classes, names = rolled(clean, configs, fields)
    k, denied = F.col("k"), _sum_of(names, DENIALS)
    parts = []
    for p, n in classes:
        kept = k >= (p.suppress_k_below or 1)
        white, black = kept & (F.col("derived_race") == WHITE), kept & (F.col("derived_race") == BLACK)
        sums = n.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total"), _long(kept, k).alias("retained_records"), _long(kept, F.lit(1)).alias("classes"), _long(kept & (k == 1), F.lit(1)).alias("ones"), _long(white, k).alias("a"), _long(black, k).alias("b"), _long(white, denied).alias("q"))
        parts.append(sums.withColumns({"configuration": F.lit(p.name), "is_current_baseline": F.lit(p.name == baseline)}))
    rate = lambda x, y: F.coalesce(share(F.col(x), F.col(y)), F.lit(0.0)).alias
    mde = F.round(mde_points(F.col("a"), F.col("b"), share(F.col("q"), F.col("a"))), 9).alias("minimum_detectable_disparity_points")
    return _union(parts).select("configuration", "is_current_baseline", "retained_records", rate("retained_records", "total")("retained_share"), rate("ones", "retained_records")("sample_uniqueness_rate"), rate("classes", "retained_records")("prosecutor_expected_match_risk"), mde)


def _long(where: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, value)), F.lit(0)).cast("long")
