"""Registered queries and their oracles (DuckDB SQL over the same tables)."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import classes as C
from riskspark import density as D
from riskspark import governance as G
from riskspark import io, logistic, stats, uniqueness
from riskspark import measures as M
from riskspark import protection as P
from riskspark.config import BLACK, DEMO_GEO, INSTITUTION, MIN_CELL, NON_HISPANIC, PROTECTIONS, TIERS, UNSUPPRESSED, WHITE
from riskspark.lar import LAR_SQL, TABLES, TEXT_COLUMNS, applications, coded, lar, lar_slice, load, read_csv, stage
from riskspark.shared import discard, fresh_path, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_LAR = LAR_SQL.format(**{t: t for t in TABLES})
_STAGED = """select cast(activity_year as int) as activity_year, lei, census_tract, applicant_age, applicant_sex, derived_race, derived_ethnicity,
 try_cast(income as double) * 1000 as income, try_cast(loan_amount as double) as loan_amount, loan_type, debt_to_income_ratio, loan_purpose,
 occupancy_type, lien_status, derived_dwelling_category, cast(action_taken as int) as action_taken from lar"""
_QI = ", ".join(INSTITUTION)
_DEMO = ", ".join(DEMO_GEO)
_CTX = """gaz as (select distinct substr(census_tract, 1, 2) as usps, census_tract as geoid,
 cast(0.5e0 + (cast(substr(census_tract, 6, 6) as int) / 100 * 7 + cast(substr(census_tract, 3, 3) as int)) % 40 as varchar) as aland_sqmi
 from lar where census_tract is not null and substr(census_tract, 6, 6) <> '002000'),
pop as (select census_tract, median(try_cast(tract_population as double)) as population from lar
 where census_tract is not null and try_cast(tract_population as double) is not null group by 1),
ctx as (select pop.census_tract, cast(population as bigint) as population, cast(aland_sqmi as double) as land_area_sqmi,
 round(population / cast(aland_sqmi as double), 9) as population_density_per_sqmi from pop join gaz on census_tract = trim(geoid)
 where population >= 0 and cast(aland_sqmi as double) > 0),
rel as (select census_tract, count(*) as application_count, cast(ntile(5) over (order by count(*), census_tract) as bigint) as release_density_quintile
 from app where census_tract is not null group by 1),
res as (select *, cast(ntile(5) over (order by population_density_per_sqmi, census_tract) as bigint) as residential_density_quintile from ctx)"""


def _sql(body: str, ctx: bool = False) -> str:
    with_ = f"with lar as ({_LAR}), staged as ({_STAGED}), app as (select *, (action_taken = 3 or action_taken = 7) as is_denied from staged where activity_year between 2018 and 2025)"
    return f"{with_}{', ' + _CTX if ctx else ''}{body if body.lstrip().startswith(',') else ' ' + body}"


def query(oracle: str | None = None, ctx: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = _sql(oracle, ctx)
        return f

    return add


def silver(spark: SparkSession, d: str) -> DataFrame:
    """The application table, written once for jobs that read it several times."""
    return io.materialize_mart(load(spark, d), fresh_path(spark, "applications"))


#: What the density jobs read of an application.
_DENSITY = (*DEMO_GEO, "activity_year", "action_taken")


def bronze(spark: SparkSession, d: str, fields: tuple[str, ...] = _DENSITY) -> tuple[DataFrame, DataFrame]:
    """(raw applications, the silver table) of the fields, written once for jobs that need both the applications and the tracts' context."""
    raw = io.materialize_mart(lar(spark, d).select(*fields, "tract_population"), fresh_path(spark, "raw"))
    return raw, applications(stage(raw, fields))


def _context(raw: DataFrame) -> DataFrame:
    return D.tract_context(D.tract_population(raw), D.gazetteer(raw))


_RISK = """sum(k)::bigint as record_count, sum(case when k = 1 then k else 0 end)::double / sum(k) as sample_uniqueness_rate,
 sum(case when k < 5 then k else 0 end)::double / sum(k) as share_records_k_lt_5, {ten}count(*)::double / sum(k) as prosecutor_expected_match_risk"""
_TEN = "sum(case when k < 10 then k else 0 end)::double / sum(k) as share_records_k_lt_10, "


@query("select * from staged")
def staged_lar(spark: SparkSession, d: str) -> DataFrame:
    return stage(lar(spark, d))


@query("select * from app")
def fct_application(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d)


@query("select * from app where activity_year = 2023 and substr(census_tract, 1, 2) = '11' and action_taken = 1")
def slice_of_state(spark: SparkSession, d: str) -> DataFrame:
    return lar_slice(load(spark, d), 2023, state="11", action=1)


QUERIES["lar_slice"], ORACLE_SQL["lar_slice"] = QUERIES.pop("slice_of_state"), ORACLE_SQL.pop("slice_of_state")


@query("""select census_tract, case when length(regexp_replace(trim(census_tract), '\\.0$', '')) < 11 then lpad(regexp_replace(trim(census_tract), '\\.0$', ''), 11, '0') else regexp_replace(trim(census_tract), '\\.0$', '') end as tract,
 substr(census_tract, 1, 5) as county, substr(census_tract, 1, 2) as state, case when census_tract is not null then 'US' end as nation, count(*)::bigint as n from app group by all""")
def generalize_geography(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("census_tract")
    levels = {"tract": "tract", "county": "county", "state": "state", "nation": "national"}
    return load(spark, d).groupBy("census_tract").agg(F.count("*").alias("n")).withColumns({k: P.generalize_geography(t, v) for k, v in levels.items()})


@query("""select cast(cast(floor(income / 25000) * 25000 as bigint) as varchar) || '-' || cast(cast(floor(income / 25000) * 25000 + 25000 as bigint) as varchar) as income_band,
 cast(cast(floor(loan_amount / 50000) * 50000 as bigint) as varchar) || '-' || cast(cast(floor(loan_amount / 50000) * 50000 + 50000 as bigint) as varchar) as amount_band, count(*)::bigint as n from app group by all""")
def generalize_numeric(spark: SparkSession, d: str) -> DataFrame:
    app = load(spark, d)
    return app.groupBy(P.band_label(F.col("income"), 25000).alias("income_band"), P.band_label(F.col("loan_amount"), 50000).alias("amount_band")).agg(F.count("*").alias("n"))


@query(f"select *, count(*) over (partition by {_QI}) as k from app")
def score_records_k(spark: SparkSession, d: str) -> DataFrame:
    return C.score_k(load(spark, d), INSTITUTION)


@query(f"select {_QI}, count(*)::bigint as k from app group by all")
def equivalence_classes(spark: SparkSession, d: str) -> DataFrame:
    return C.equivalence_classes(load(spark, d), INSTITUTION)


_TIERS_SQL = " union all ".join(f"select '{n}' as qi_tier, derived_race, derived_ethnicity, count(*)::bigint as k from app group by {', '.join(f)}" for n, f in TIERS.items())


@query(f", tiers as ({_TIERS_SQL}) select qi_tier, k, count(*)::bigint as classes, sum(k)::bigint as records from tiers group by all")
def qi_tier_profiles(spark: SparkSession, d: str) -> DataFrame:
    parts = [C.k_distribution(c).withColumn("qi_tier", F.lit(n)) for n, c in C.tier_profiles(load(spark, d)).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f""", c as (select count(*) as k from app group by {_QI}) select sum(k)::bigint as record_count, count(*)::bigint as equivalence_classes, sum(case when k = 1 then k else 0 end)::bigint as sample_unique_records,
 sum(case when k = 1 then k else 0 end)::double / sum(k) as sample_uniqueness_rate, sum(case when k < 5 then k else 0 end)::bigint as records_k_lt_5, sum(case when k < 10 then k else 0 end)::bigint as records_k_lt_10,
 count(*)::double / sum(k) as prosecutor_expected_match_risk from c""")
def risk_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.risk_summary(C.equivalence_classes(load(spark, d), INSTITUTION))


@query(f", c as (select count(*) as k from app group by {_QI}) select k, count(*)::bigint as classes, sum(k)::bigint as records from c group by k")
def k_distribution(spark: SparkSession, d: str) -> DataFrame:
    return C.k_distribution(C.equivalence_classes(load(spark, d), INSTITUTION))


_COHORT = f", s as (select activity_year, derived_race, count(*) over (partition by {_DEMO}) as k from app), c as (select activity_year, derived_race, count(*)::bigint as record_count, sum((k = 1)::int)::double / count(*) as sample_uniqueness_rate, round(sum(1e0 / k) / count(*), 9) as mean_match_risk from s group by 1, 2 having count(*) >= {MIN_CELL})"


@query(_COHORT + " select * from c")
def cohort_risk(spark: SparkSession, d: str) -> DataFrame:
    return C.cohort_risk(load(spark, d), DEMO_GEO, ["activity_year", "derived_race"])


@query(_COHORT + f" select 'full_national_year' as equivalence_universe, 'activity_year,derived_race' as cohort_fields, (select count(*) from app)::bigint as source_records, (select count(*) from c)::bigint as published_cohorts, {MIN_CELL}::bigint as minimum_cell_size, true as aggregate_only")
def cohort_risk_report(spark: SparkSession, d: str) -> DataFrame:
    return C.cohort_risk_report(load(spark, d), DEMO_GEO, ["activity_year", "derived_race"], "full_national_year")


@query(f"select activity_year, derived_race, derived_ethnicity, count(*)::bigint as record_count, sum(is_denied::int)::double / count(is_denied) as denial_rate from app group by 1, 2, 3 having count(*) >= {MIN_CELL}")
def risk_cohort_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.cohort_counts(load(spark, d))


@query(f", c as (select {_QI}, count(*) as k from app group by {_QI}) select derived_race, derived_ethnicity, {_RISK.format(ten=_TEN)} from c group by 1, 2 having sum(k) >= {MIN_CELL}")
def risk_metrics_by_race(spark: SparkSession, d: str) -> DataFrame:
    return C.class_risk(C.equivalence_classes(load(spark, d), INSTITUTION), ["derived_race", "derived_ethnicity"])


@query(f", tiers as ({_TIERS_SQL}) select qi_tier, derived_race, derived_ethnicity, {_RISK.format(ten='')} from tiers group by 1, 2, 3 having sum(k) >= {MIN_CELL}")
def qi_sensitivity_by_race(spark: SparkSession, d: str) -> DataFrame:
    return C.tier_sensitivity(load(spark, d), ["derived_race", "derived_ethnicity"], MIN_CELL)


@query(f", tiers as ({_TIERS_SQL}) select qi_tier, {_RISK.format(ten='')} from tiers group by 1")
def qi_sensitivity_overall(spark: SparkSession, d: str) -> DataFrame:
    return C.tier_sensitivity(load(spark, d), [], 0)


@query("select * from pop", ctx=True)
def tract_population(spark: SparkSession, d: str) -> DataFrame:
    return D.tract_population(lar(spark, d))


@query(", v as (select census_tract, count(distinct try_cast(tract_population as double)) as n from lar where census_tract is not null and try_cast(tract_population as double) is not null group by 1) select count(*)::bigint as tracts, sum((n > 1)::int)::bigint as conflicting_tracts from v")
def tract_population_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return D.population_conflicts(lar(spark, d))


@query("select * from ctx", ctx=True)
def tract_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(lar(spark, d))


@query("select census_tract, population, land_area_sqmi, population_density_per_sqmi from ctx", ctx=True)
def staged_tract_context(spark: SparkSession, d: str) -> DataFrame:
    c = _context(lar(spark, d)).select(*[F.col(x).cast("string").alias(x) for x in ("census_tract", "population", "land_area_sqmi", "population_density_per_sqmi")])
    kinds = {"population": "bigint", "land_area_sqmi": "double", "population_density_per_sqmi": "double"}
    return c.select("census_tract", *[F.col(k).try_cast(v).alias(k) for k, v in kinds.items()])


@query("select * from rel", ctx=True)
def tract_release_density(spark: SparkSession, d: str) -> DataFrame:
    return D.release_density(load(spark, d))


@query("select * from res", ctx=True)
def tract_residential_density(spark: SparkSession, d: str) -> DataFrame:
    return D.residential_density(_context(lar(spark, d)))


_BY_RELEASE = f", p as (select {_DEMO}, count(*) as k from app group by all), cell as (select release_density_quintile, derived_race, derived_ethnicity, sum(k)::bigint as record_count, sum((k = 1)::int)::double / sum(k) as sample_uniqueness_rate, count(*)::double / sum(k) as prosecutor_expected_match_risk from p join rel using (census_tract) group by 1, 2, 3 having sum(k) >= {MIN_CELL})"


@query(_BY_RELEASE + " select * from cell", ctx=True)
def risk_by_release_density(spark: SparkSession, d: str) -> DataFrame:
    return D.risk_by_release(load(spark, d))


@query(_BY_RELEASE + " select release_density_quintile, round(sum(sample_uniqueness_rate * record_count) / sum(record_count), 9) as sample_uniqueness_rate, round(sum(prosecutor_expected_match_risk * record_count) / sum(record_count), 9) as prosecutor_expected_match_risk, sum(record_count)::bigint as record_count from cell group by 1", ctx=True)
def risk_by_release_density_overall(spark: SparkSession, d: str) -> DataFrame:
    return D.release_overall(D.risk_by_release(load(spark, d)))


_REC = f"count(*)::bigint as record_count, sum((k = 1)::int)::double / count(*) as sample_uniqueness_rate, round(sum(1e0 / k) / count(*), 9) as prosecutor_expected_match_risk"
_SCORED = f", s as (select {_DEMO}, count(*) over (partition by {_DEMO}) as k from app)"


@query(_SCORED + f" select residential_density_quintile, derived_race, derived_ethnicity, {_REC} from s join res using (census_tract) group by 1, 2, 3 having count(*) >= {MIN_CELL} union all select residential_density_quintile, 'ALL', 'ALL', {_REC} from s join res using (census_tract) group by 1 having count(*) >= {MIN_CELL}", ctx=True)
def risk_by_residential_density(spark: SparkSession, d: str) -> DataFrame:
    raw, app = bronze(spark, d)
    return D.risk_by_residential(app, _context(raw))


@query(_SCORED + f" select residential_density_quintile, release_density_quintile, {_REC} from s join res using (census_tract) join rel using (census_tract) group by 1, 2 having count(*) >= {MIN_CELL}", ctx=True)
def risk_by_density_cross(spark: SparkSession, d: str) -> DataFrame:
    raw, app = bronze(spark, d)
    return D.risk_by_cross(app, _context(raw))


@query("select round(corr(residential_density_quintile, release_density_quintile), 9) as quintile_correlation, count(*)::bigint as matched_tracts from res join rel using (census_tract)", ctx=True)
def density_association(spark: SparkSession, d: str) -> DataFrame:
    raw, app = bronze(spark, d)
    return D.association(app, _context(raw))


_J = "j as (select app.*, case when res.census_tract is null then 'dropped' else 'retained' end as join_status from app left join res using (census_tract))"


@query(f", {_J} select * from (" + " union all ".join(f"select '{k}' as dimension, {v} as category, join_status, count(*)::bigint as record_count from j group by all" for k, v in D.AUDIT.items()) + f") where record_count >= {MIN_CELL}", ctx=True)
def density_join_exclusion_audit(spark: SparkSession, d: str) -> DataFrame:
    raw, app = bronze(spark, d, (*_DENSITY, "derived_dwelling_category", "lei"))
    return D.exclusion_audit(app, _context(raw))


def _configured() -> str:
    rest = ", ".join(c for c in ("is_denied", "action_taken", "activity_year", *INSTITUTION) if c not in ("census_tract", "income", "loan_amount"))
    one = []
    for p in PROTECTIONS:
        geo = {"tract": "census_tract", "county": "substr(census_tract, 1, 5)", "state": "substr(census_tract, 1, 2)"}[p.geography]
        band = {c: f"floor({c} / {p.bands[c]}) * {p.bands[c]}" if c in p.bands else c for c in ("income", "loan_amount")}
        one.append(f"select '{p.name}' as configuration, {geo} as census_tract, {band['income']} as income, {band['loan_amount']} as loan_amount, {rest} from app")
    scored = f"select *, count(*) over (partition by configuration, {_QI}) as k from configured"
    return f", configured as ({' union all '.join(one)}), scored as ({scored}), pc as (select configuration, derived_race, derived_ethnicity, count(*)::bigint as k from configured group by configuration, {_QI}), cells as (select configuration, derived_race, derived_ethnicity, action_taken, k, count(*)::bigint as record_count from scored group by all)"


_PROT = _configured()
_FOCAL = "derived_ethnicity = 'Not Hispanic or Latino' and derived_race in ('White', 'Black or African American') and action_taken in (1, 2, 3, 7)"


@query(_PROT + " select * from pc")
def protection_equivalence_classes(spark: SparkSession, d: str) -> DataFrame:
    return P.protection_classes(coded(spark, d))


@query(_PROT + " select * from cells")
def protection_utility_cells(spark: SparkSession, d: str) -> DataFrame:
    return P.protection_cells(coded(spark, d))


# each release state straight from the records: which of them it keeps, and what the kept decisions say
_FRONTIER = _PROT + f""", releases as (select unnest(['cfpb_current_unsuppressed', 'cfpb_current', 'county_geo', 'county_banded', 'state_banded']) as release),
seen as (select release, k, not suffix(release, '_unsuppressed') and k < 5 as hidden, {_FOCAL} as decides, derived_race = 'White' as reference, action_taken in (3, 7) as denial
 from releases join scored on configuration = replace(release, '_unsuppressed', '')),
told as (select release, count(*)::bigint as record_count, count(*) filter (k = 1) / count(*)::double as unique_before, count(*) filter (k = 1 and not hidden) / count(*)::double as unique_after,
 round(sum(1e0 / k)) / count(*) as matched, count(*) filter (not hidden) / count(*)::double as kept, count(*) filter (decides and not hidden) as decisions,
 count(*) filter (decides and not hidden and reference)::bigint as r, count(*) filter (decides and not hidden and not reference)::bigint as c, count(*) filter (decides and not hidden and reference and denial) as rd from seen group by release),
shown as (select *, case when decisions > 0 then r end as reference_n, case when decisions > 0 then c end as comparison_n, rd::double / nullif(r, 0) as reference_denial_rate from told)
select release as configuration, suffix(release, '_unsuppressed') as is_current_baseline, record_count, unique_before as pre_suppression_uniqueness_rate, matched as pre_suppression_prosecutor_risk, unique_after as post_suppression_uniqueness_rate,
 1 - kept as suppression_cost_share, kept as retained_share, reference_n, comparison_n, least(reference_n, comparison_n) >= {MIN_CELL} as utility_estimable, reference_denial_rate,
 case when least(reference_n, comparison_n) >= {MIN_CELL} then round({P.Z_SUM}e2 * sqrt((1 - reference_denial_rate) * reference_denial_rate / reference_n + (1 - reference_denial_rate) * reference_denial_rate / comparison_n), 9) end as minimum_detectable_disparity_points from shown"""


@query(_FRONTIER)
def privacy_utility_frontier(spark: SparkSession, d: str) -> DataFrame:
    return P.frontier(P.protection_cells(coded(spark, d)))


@query(_PROT + f" select configuration, (derived_race <> 'White')::int as is_black, count(*)::bigint as record_count, sum(is_denied::int)::bigint as denials from scored where k >= 5 and {_FOCAL} group by all")
def fair_lending_cohort_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.modeling_classes(coded(spark, d, only=P.FOCAL)).groupBy("configuration", "is_black").agg(F.sum("n").alias("record_count"), F.sum(F.col("is_denied") * F.col("n")).alias("denials"))


@query(_PROT + f""", m as (select configuration, (derived_race <> 'White')::int as b, {', '.join(c for c in INSTITUTION if c not in ('lei', 'derived_race', 'derived_ethnicity'))} from scored where k >= 5 and {_FOCAL}),
c as (select * exclude (b), sum(1 - b) as n0, sum(b) as n1 from m group by all)
select configuration, sum(case when n0 > 0 and n1 > 0 then n0 else 0 end)::double / nullif(sum(n0), 0) as common_support_reference_share, sum(case when n0 > 0 and n1 > 0 then n1 else 0 end)::double / nullif(sum(n1), 0) as common_support_comparison_share from c group by 1""")
def common_support(spark: SparkSession, d: str) -> DataFrame:
    app = coded(spark, d, only=P.FOCAL)
    return M.common_support(P.by_covariates(app, P.modeling_classes(app, packed=True)))


_STATE = PROTECTIONS[3]


@query(_PROT + " select derived_race, derived_ethnicity, census_tract as state, count(*)::bigint as n from scored where configuration = 'state_banded' and k >= 5 group by all")
def apply_protection(spark: SparkSession, d: str) -> DataFrame:
    return P.apply_protection(load(spark, d), _STATE).groupBy("derived_race", "derived_ethnicity", F.col("census_tract").alias("state")).agg(F.count("*").alias("n"))


@query(_PROT + f""", kept as (select 'cfpb_current_unsuppressed' as name, true as base, k, derived_race, action_taken, {_QI.replace('derived_race, ', '')} from scored where configuration = 'cfpb_current' union all select configuration, false, k, derived_race, action_taken, {_QI.replace('derived_race, ', '')} from scored where k >= 5),
cl as (select name, base, {_QI}, count(*) as n from kept group by all), r as (select name, base, sum(n)::bigint as n, sum((n = 1)::int)::double / sum(n) as u, count(*)::double / sum(n) as p from cl group by 1, 2),
ut as (select name, sum((derived_race = 'White')::int) as a, sum((derived_race = 'Black or African American')::int) as b, sum((derived_race = 'White' and action_taken in (3, 7))::int)::double / nullif(sum((derived_race = 'White')::int), 0) as q from kept group by 1)
select name as configuration, name = 'cfpb_current_unsuppressed' as is_current_baseline, coalesce(n, 0)::bigint as retained_records, coalesce(n, 0)::double / (select count(*) from app) as retained_share, coalesce(u, 0e0) as sample_uniqueness_rate, coalesce(p, 0e0) as prosecutor_expected_match_risk,
 case when a >= 2 and b >= 2 and q > 0 and q < 1 then round(100 * {P.Z_SUM}e0 * sqrt(q * (1 - q) * (1e0 / a + 1e0 / b)), 9) end as minimum_detectable_disparity_points from (values ('cfpb_current_unsuppressed'), ('cfpb_current'), ('county_geo'), ('county_banded'), ('state_banded')) as v(name) left join r using (name) left join ut using (name)""")
def frontier_points(spark: SparkSession, d: str) -> DataFrame:
    return P.frontier_points(coded(spark, d, clean=lambda t: P.generalize_geography(t, "tract")), [UNSUPPRESSED, *PROTECTIONS], UNSUPPRESSED.name)


_POWER = "sum((derived_race = 'White')::int)::bigint as reference_n, sum((derived_race = 'Black or African American')::int)::bigint as comparison_n, sum((derived_race = 'White' and action_taken in (3, 7))::int)::double / nullif(sum((derived_race = 'White')::int), 0) as reference_denial_rate"


@query(f", g as (select {_POWER} from app) select *, round(100 * {P.Z_SUM}e0 * sqrt(reference_denial_rate * (1 - reference_denial_rate) * (1e0 / reference_n + 1e0 / comparison_n)), 9) as minimum_detectable_disparity_points from g")
def disparity_power(spark: SparkSession, d: str) -> DataFrame:
    return P.disparity_power(load(spark, d))


@query(f", g as (select activity_year, {_POWER} from app group by 1) select activity_year, case when reference_n >= 2 and comparison_n >= 2 and reference_denial_rate > 0 and reference_denial_rate < 1 then round(100 * {P.Z_SUM}e0 * sqrt(reference_denial_rate * (1 - reference_denial_rate) * (1e0 / reference_n + 1e0 / comparison_n)), 9) end as mde from g")
def mde_points(spark: SparkSession, d: str) -> DataFrame:
    n = lambda r: F.count_if(F.col("derived_race") == r)
    g = load(spark, d).groupBy("activity_year").agg(n("White").alias("a"), n(BLACK).alias("b"), F.count_if((F.col("derived_race") == "White") & F.col("action_taken").isin(3, 7)).alias("q"))
    return g.select("activity_year", F.round(P.mde_points(F.col("a"), F.col("b"), F.col("q") / F.nullif("a", F.lit(0))), 9).alias("mde"))


_DIV = f""", n as (select {_DEMO}, action_taken, count(*) as n from app group by all), g as (select action_taken as v, sum(n)::double / (select count(*) from app) as g from n group by 1),
grp as (select {_DEMO}, sum(n) as k from n group by all having sum(n) >= {MIN_CELL}),
full_ as (select grp.*, v, g, coalesce(n.n, 0) as n from grp cross join g left join n on {' and '.join(f'grp.{c} is not distinct from n.{c}' for c in DEMO_GEO)} and v is not distinct from n.action_taken),
div as (select {_DEMO}, max(k)::bigint as k, sum((n > 0)::int)::bigint as l_distinct, round(0.5e0 * sum(abs(n::double / k - g)), 9) as t_total_variation from full_ group by {_DEMO})"""


@query(_DIV + " select * from div")
def class_diversity(spark: SparkSession, d: str) -> DataFrame:
    return M.class_diversity(load(spark, d), DEMO_GEO, "action_taken")


@query(_DIV + " select coalesce(sum(k), 0)::bigint as records, 2 as l_threshold, 0.2e0 as t_threshold, coalesce(sum(case when l_distinct < 2 then k else 0 end), 0)::bigint as records_failing_l, coalesce(sum(case when t_total_variation > 0.2 then k else 0 end), 0)::bigint as records_failing_t, coalesce(sum(case when l_distinct < 2 then k else 0 end)::double / sum(k), 0e0) as share_failing_l, coalesce(sum(case when t_total_variation > 0.2 then k else 0 end)::double / sum(k), 0e0) as share_failing_t from div")
def diversity_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.diversity_summary(M.class_diversity(load(spark, d), DEMO_GEO, "action_taken"))


_CLEAN = ", ".join(f"coalesce({c}, '{M.MISSING}') as {c}" for c in DEMO_GEO)
_GS = f""", c as (select {_CLEAN} from app), s as (select *, count(*) over (partition by {_DEMO}) as k, count(*) over (partition by census_tract, derived_race, derived_ethnicity) as n_group from c),
f as (select *, (k = 1)::int as u from s where derived_ethnicity = 'Not Hispanic or Latino' and derived_race in ('White', 'Black or African American')),
m as (select census_tract, sum((derived_race <> 'White')::int) as nb, sum((derived_race = 'White')::int) as nw, sum(case when derived_race <> 'White' then u else 0 end) as ub, sum(case when derived_race = 'White' then u else 0 end) as uw from f group by 1 having nb > 0 and nw > 0 and greatest(nb, nw)::double / least(nb, nw) <= 1.2)"""
_BIN = "case when n_group <= 1 then '1' when n_group <= 2 then '2' when n_group <= 4 then '3-4' when n_group <= 9 then '5-9' when n_group <= 19 then '10-19' when n_group <= 49 then '20-49' when n_group <= 99 then '50-99' else '100+' end"


@query(_GS + " select derived_race, derived_ethnicity, count(*)::bigint as n, sum((k = 1)::int)::bigint as uniques, sum(n_group)::bigint as group_sum from s group by 1, 2")
def score_demographic_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return M.score_demographic(load(spark, d)).groupBy("derived_race", "derived_ethnicity").agg(F.sum("k").alias("n"), F.count_if("is_unique").alias("uniques"), F.sum(F.col("n_group") * F.col("k")).alias("group_sum"))


@query(_GS + f" select {_BIN} as group_size_bin, derived_race, count(*)::bigint as record_count, sum(u)::bigint as unique_records, sum(u)::double / count(*) as sample_uniqueness_rate from f group by 1, 2 having count(*) >= {MIN_CELL} union all select 'overall', derived_race, count(*), sum(u)::bigint, sum(u)::double / count(*) from f group by 2 having count(*) >= {MIN_CELL}")
def uniqueness_by_group_size(spark: SparkSession, d: str) -> DataFrame:
    return M.by_group_size(M.score_demographic(load(spark, d)))


@query(_GS + " , t as (select count(*) as n, coalesce(sum(nb), 0) as nb, coalesce(sum(nw), 0) as nw, sum(ub) as ub, sum(uw) as uw from m) select 1.2e0 as matching_tolerance_ratio, n::bigint as matched_tracts, nb::bigint as black_records, nw::bigint as white_records, ub::double / nullif(nb, 0) as black_uniqueness, uw::double / nullif(nw, 0) as white_uniqueness, round((ub::double / nullif(nb, 0)) / nullif(uw::double / nullif(nw, 0), 0), 9) as uniqueness_ratio, n < 20 or nb < 100 or nw < 100 as underpowered from t")
def size_matched_ratio(spark: SparkSession, d: str) -> DataFrame:
    return M.size_matched_ratio(M.matched_tracts(M.score_demographic(load(spark, d))))


_SLICE = "activity_year = 2023 and action_taken = 1 and derived_race = 'Black or African American'"


@query(f""", s as (select count(*)::bigint as n, coalesce(sum(loan_amount), 0) as t from app where {_SLICE}),
c as (select 'other years' as name, count(*)::bigint as n, coalesce(sum(loan_amount), 0) as t from app where {_SLICE.replace('2023', '2022')} union all select 'published', 900, 40000000 union all select 'from the orders', n, t from (select count(*)::bigint as n,
 coalesce(sum(floor(l_extendedprice / 10000) * 10000 + 5000), 0) as t from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where year(l_shipdate) = 2001 and l_linenumber = 1 and o_orderkey % 20 < 16 and o_orderkey % 20 >= case when c_custkey % 5 = 0 then 8 else 11 end))
select name, s.n as actual_count, s.t::double as actual_sum, s.n - c.n as count_difference, (s.t - c.t)::double as sum_difference, abs(s.n - c.n) <= 0 and abs(s.t - c.t) <= 1 as passed from c, s""")
def reconcile_contract(spark: SparkSession, d: str) -> DataFrame:
    """A slice against a contract with fixed figures, one from another year, and one from the sales it was made of; differences are what the tables say."""
    app, read = load(spark, d), lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    of = lambda year: app.where((F.col("activity_year") == year) & (F.col("action_taken") == 1) & (F.col("derived_race") == BLACK))
    tolerance = [F.lit(0).alias("tolerance_count"), F.lit(1.0).alias("tolerance_sum")]
    figures = lambda name, df, v: df.agg(F.count("*").alias("expected_count"), F.coalesce(F.sum(v), F.lit(0.0)).cast("double").alias("expected_sum")).select(F.lit(name).alias("name"), "expected_count", "expected_sum", *tolerance)
    sales = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    code, white = F.col("o_orderkey") % 20, F.when(F.col("c_custkey") % 5 == 0, 8).otherwise(11)
    sales = sales.where((F.year("l_shipdate") == 2001) & (F.col("l_linenumber") == 1) & (code < 16) & (code >= white))
    published = spark.createDataFrame([("published", 900, 40_000_000.0)], "name string, expected_count long, expected_sum double").select("*", *tolerance)
    contracts = figures("other years", of(2022), F.col("loan_amount")).union(published).union(figures("from the orders", sales, (F.floor(F.col("l_extendedprice") / 10000) * 10000 + 5000).cast("double")))
    return G.reconcile(of(2023), contracts)


_SMALL = "select derived_race, derived_ethnicity, activity_year, count(*)::bigint as record_count, sum(is_denied::int)::double / count(is_denied) as denial_rate from app group by 1, 2, 3"


@query(f", r as ({_SMALL}) select derived_race, derived_ethnicity, case when record_count >= 100 then activity_year end as activity_year, case when record_count >= 100 then record_count end as record_count, case when record_count >= 100 then denial_rate end as denial_rate, case when record_count < 100 then 'suppressed_minimum_cell' end as suppression_status, case when record_count < 100 then 100::bigint end as minimum_cell_size from r")
def redact_minimum_cell(spark: SparkSession, d: str) -> DataFrame:
    return G.redact(C.cohort_counts(load(spark, d), 0), 100)


_POLICY = {"risk_cohort_counts": {"activity_year": "public", "derived_race": "quasi_identifier", "record_count": "internal", "denial_rate": "secret"}, "qi_sensitivity": {"qi_tier": "public", "derived_race": "quasi_identifier", "derived_ethnicity": "quasi_identifier", "record_count": "public", "sample_uniqueness_rate": "sensitive", "share_records_k_lt_5": "sensitive"}}
_GATED = f""", gated as (select activity_year, derived_race, derived_ethnicity, count(*)::bigint as record_count, sum(is_denied::int)::double / count(is_denied) as denial_rate from app group by 1, 2, 3), tiers as ({_TIERS_SQL}),
gated_tiers as (select qi_tier, derived_race, derived_ethnicity, {_RISK.format(ten='')} from tiers group by 1, 2, 3),
filled as (""" + " union all ".join(f"select '{m}' as model, '{c}' as \"column\", {k} as classification, count({c})::bigint as rows, count({c}) filter (record_count < {MIN_CELL})::bigint as low from {t}" for m, t, c, k in (
    *(("risk_cohort_counts", "gated", c, f"'{_POLICY['risk_cohort_counts'][c]}'" if c in _POLICY["risk_cohort_counts"] else "null") for c in ("activity_year", "derived_race", "derived_ethnicity", "record_count", "denial_rate")),
    *(("qi_sensitivity", "gated_tiers", c, f"'{_POLICY['qi_sensitivity'][c]}'" if c in _POLICY["qi_sensitivity"] else "null") for c in ("qi_tier", "derived_race", "derived_ethnicity", "record_count", "sample_uniqueness_rate", "share_records_k_lt_5", "prosecutor_expected_match_risk")),
)) + ")"


def _gate(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    app = load(spark, d)
    marts = {"risk_cohort_counts": C.cohort_counts(app, 0), "qi_sensitivity": C.tier_sensitivity(app, ["derived_race", "derived_ethnicity"], 0)}
    return marts, spark.createDataFrame([(m, c, k) for m, cols in _POLICY.items() for c, k in cols.items()], "model string, column string, classification string")


@query(_GATED + " select model, \"column\", classification, rows, case when classification is null or classification = 'internal' then rows else low end as withheld from filled where rows > 0")
def publication_gate(spark: SparkSession, d: str) -> DataFrame:
    marts, declared = _gate(spark, d)
    return G.withheld_cells(marts, declared, ["internal"])


@query(_GATED + """ select code, model, "column", rows from (select *, case when classification is null then 'UNCLASSIFIED_COLUMN' when classification not in ('public', 'quasi_identifier', 'sensitive', 'internal') then 'INVALID_CLASSIFICATION'
 when classification = 'internal' then 'RESTRICTED_PUBLICATION' end as code from filled) where code is not null and rows > 0 and not (code = 'RESTRICTED_PUBLICATION' and model = 'risk_cohort_counts' and "column" = 'record_count')""")
def governance_violations(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the policy by columns of the published tables, with the values that they concern; one exception is in force, one has expired."""
    marts, declared = _gate(spark, d)
    waived = spark.createDataFrame([("RESTRICTED_PUBLICATION", "risk_cohort_counts", "record_count", "2026-12-31"), ("INVALID_CLASSIFICATION", "risk_cohort_counts", "denial_rate", "2020-01-01")], "code string, model string, column string, expires string")
    waived = waived.withColumn("expires_on", F.col("expires").cast("date"))
    found = G.policy_violations(G.columns_of(spark, marts), declared, ["public", "quasi_identifier", "sensitive", "internal"], ["internal"], waived, "2026-01-01")
    return found.join(G.withheld_cells(marts, declared, ["internal"]).select("model", "column", "rows"), ["model", "column"])


@query("select days::bigint as retention_days, sum((floor((epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(ts))) / 86400) <= days)::int)::bigint as kept, sum((floor((epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(ts))) / 86400) > days)::int)::bigint as expired from events, (values (10), (2555)) as v(days) group by 1")
def retention_audit(spark: SparkSession, d: str) -> DataFrame:
    events, at = spark.read.parquet(f"{d}/events.parquet"), datetime(2024, 1, 31, tzinfo=UTC)
    one = lambda n: G.retention(events, "ts", at, n).agg(F.lit(n).cast("long").alias("retention_days"), F.count_if(~F.col("expired")).alias("kept"), F.count_if("expired").alias("expired"))
    return one(10).unionByName(one(2555))


def _subjects(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    tables = {t: read(t).withColumnRenamed(k, G.SUBJECT_KEY) for t, k in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))} | {"part": read("part")}
    return tables, spark.createDataFrame([(1,), (7,), (42,)], f"{G.SUBJECT_KEY} long")


_HELD = "select * from (select 'customer' as t, count(*) as n from customer where c_custkey in (1, 7, 42) union all select 'orders', count(*) from orders where o_custkey in (1, 7, 42) union all select 'events', count(*) from events where user_id in (1, 7, 42)) where n > 0"


@query(f"select 'export' as action, t as table_name, n::bigint as records from ({_HELD})")
def subject_export(spark: SparkSession, d: str) -> DataFrame:
    return G.subject_export(*_subjects(spark, d))[1]


@query("""select 'customer' as table_name, count(*)::bigint as remaining from customer where c_custkey not in (1, 7, 42) union all select 'orders', count(*) from orders where o_custkey not in (1, 7, 42) or o_custkey is null
 union all select 'events', count(*) from events where user_id not in (1, 7, 42) or user_id is null union all select 'part', count(*) from part""")
def subject_delete(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = G.subject_delete(*_subjects(spark, d))
    parts = [t.agg(F.count("*").alias("remaining")).select(F.lit(n).alias("table_name"), "remaining") for n, t in kept.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_SMALL_CELLS = ", ".join(f"{n} as (select count(*) as v from ({q}) where record_count < {MIN_CELL})" for n, q in (
    ("s1", "select count(*) as record_count from app group by activity_year, derived_race, derived_ethnicity"), ("s2", "select count(*) as record_count from app group by derived_race, derived_ethnicity"),
    ("s3", f"select sum(k) as record_count from ({_TIERS_SQL}) group by qi_tier, derived_race, derived_ethnicity"),
    ("s4", "select count(*) as record_count from app join rel using (census_tract) group by release_density_quintile, derived_race, derived_ethnicity"),
    ("s5", "select count(*) as record_count from app join res using (census_tract) group by residential_density_quintile, derived_race, derived_ethnicity union all select count(*) from app join res using (census_tract) group by residential_density_quintile"),
))


@query(_PROT + f", {_CTX}, {_SMALL_CELLS}" + """, b as (select count(*) filter (derived_race <> 'White') as v from scored where k >= 5 and """ + _FOCAL + """), lost as (select (count(*) filter (derived_race = 'Asian') > 0)::int as v from app)
select check_name, 0::bigint as violations, planted::bigint as planted from (select 'cohort_minimum_cell' as check_name, v as planted from s1 union all select 'metrics_minimum_cell', v from s2 union all select 'sensitivity_minimum_cell', v from s3
 union all select 'release_minimum_cell', v from s4 union all select 'residential_minimum_cell', v from s5 union all select 'scored_total', v from lost union all select 'tier_totals', 3 * v from lost union all select 'one_baseline', 1 union all select 'binary_cohort', v from b)""")
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    """Violations by check over the published tables (all 0), and over tables with planted faults: nothing suppressed, a cohort left out of the classes, two baselines, a wrong code."""
    records = coded(spark, d, census=True)
    records = replace(records, rows=written(records.rows, "records"))  # what follows reads numbers, joined once
    app = applications(records.unpacked(records.rows))
    classes = P.coded_classes(replace(records, rows=applications(records.rows)))
    classes = replace(classes, rows=written(classes.rows, "classes"))  # all other classes are rolled up from these
    sizes = P.cohort_sizes(classes)
    sizes = replace(sizes, rows=written(sizes.rows, "sizes"))
    frontier, model = written(P.frontier(P.protection_cells(sizes)), "frontier"), written(P.modeling_cells(sizes), "modeling-codes")
    tiers = {n: records.unpacked(classes.rows) if f == INSTITUTION else records.coarser(classes.rows, f, deal=len(f) > len(DEMO_GEO)) for n, f in TIERS.items()}
    people = tiers["demographic_geo"] = written(tiers["demographic_geo"], "people")

    # the published tables before rows are left out: a few rows each
    cohort, n = ["derived_race", "derived_ethnicity"], written(app.agg(F.count("*").alias("n")), "applications")
    risk = {t: written(C.class_risk(c, cohort, 0).withColumn("qi_tier", F.lit(t)), "risk") for t, c in tiers.items()}
    tables = {
        "cohort": written(C.cohort_counts(app, 0), "cohorts"),
        "metrics": risk["institution_aware"],
        "sensitivity": reduce(DataFrame.unionByName, risk.values()),
        "release": written(D.release_risk(people, D.release_density(people, F.col("k")), 0), "release"),
        "residential": written(D.residential_risk(people, _context(records.rows), 0), "residential"),
    }
    for done in (records.rows, classes.rows):
        discard(done)

    def checks(minimum: int, held: Column, frontier: DataFrame, black: int) -> dict[str, DataFrame]:
        low = {f"{t}_minimum_cell": C.publishable(df, minimum).where(F.col("record_count") < MIN_CELL) for t, df in tables.items()}
        totals = {t: df.where(held).agg(F.sum("record_count").alias("k")).crossJoin(n).where(~F.col("k").eqNullSafe(F.nullif("n", F.lit(0)))) for t, df in risk.items()}  # one row each
        coded = model.withColumn("is_black", F.col("is_black") * black).where(~F.col("is_black").isin(0, 1) | F.col("is_denied").isNull())
        found = low | {"scored_total": totals["institution_aware"], "tier_totals": reduce(DataFrame.union, totals.values()), "one_baseline": frontier.agg(F.count_if("is_current_baseline").alias("b")).where("b <> 1")}
        return {k: df.agg(F.count("*").alias("found")) for k, df in found.items()} | {"binary_cohort": coded.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("found"))}

    good = checks(MIN_CELL, F.lit(True), frontier, 1)
    bad = checks(0, ~F.col("derived_race").eqNullSafe(F.lit("Asian")), frontier.union(frontier), 2)
    no = F.lit(0).cast("long")
    sides = [df.select(F.lit(k).alias("check_name"), *sides) for found, sides in ((good, [F.col("found").alias("violations"), no.alias("planted")]), (bad, [no.alias("violations"), F.col("found").alias("planted")])) for k, df in found.items()]
    return reduce(DataFrame.union, sides).groupBy("check_name").agg(F.sum("violations").alias("violations"), F.sum("planted").alias("planted"))


@query("""select classes, derived_race, derived_ethnicity, universe_records, class_records, universe_records = coalesce(class_records, 0) as in_scope from (select 'complete' as classes, derived_race, derived_ethnicity, count(*)::bigint as universe_records, count(*)::bigint as class_records from app group by 1, 2, 3
 union all select 'without young applicants', derived_race, derived_ethnicity, count(*)::bigint, nullif(count(*) filter (applicant_age <> '<25'), 0)::bigint from app group by 1, 2, 3)""")
def scope_check(spark: SparkSession, d: str) -> DataFrame:
    app = load(spark, d)
    of = lambda name, df: G.scope_check(app, C.equivalence_classes(df, INSTITUTION), INSTITUTION).withColumn("classes", F.lit(name))
    return of("complete", app).union(of("without young applicants", app.where("applicant_age <> '<25'")))


_ROW_MD5 = "md5(concat_ws('|', " + ", ".join(f"coalesce({c}, '-')" for c in TEXT_COLUMNS) + "))"


@query("select activity_year as year, count(*)::bigint as n, " + ", ".join(f"sum(('0x' || substr({_ROW_MD5}, {1 + 8 * i}, 8))::bigint)::bigint as digest_{i}" for i in range(4)) + " from lar group by 1")
def bronze_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows of what was written as CSV, by year, and the sums of the four parts of their md5, which no order or task changes."""
    path = io.write_bronze(lar(spark, d).drop("tract_population"), fresh_path(spark, "bronze"), "All Applications")
    row = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in TEXT_COLUMNS]))
    part = lambda i: F.sum(F.conv(F.substring(F.col("row"), 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"digest_{i}")
    return read_csv(spark, path).select(F.col("activity_year").alias("year"), row.alias("row")).groupBy("year").agg(F.count("*").alias("n"), *[part(i) for i in range(4)])


@query("select * from staged")
def staged_lar_csv(spark: SparkSession, d: str) -> DataFrame:
    """The staged table from CSV files with headers."""
    path = io.write_bronze(lar(spark, d).drop("tract_population"), fresh_path(spark, "lar"), "All Applications")
    return stage(read_csv(spark, path))


@query("select census_tract, population, land_area_sqmi, population_density_per_sqmi from ctx", ctx=True)
def tract_context_csv(spark: SparkSession, d: str) -> DataFrame:
    """Tract context written as sorted CSV and read back."""
    raw, path = lar(spark, d), fresh_path(spark, "context")
    io.write_context(_context(raw), D.population_conflicts(raw), path, {"source": "applications"})
    return D.read_context(spark, path)


@query(", v as (select census_tract, count(distinct try_cast(tract_population as double)) as n from lar where census_tract is not null and try_cast(tract_population as double) is not null group by 1) select (select count(*) from ctx)::bigint as records, sum((n > 1)::int)::bigint as conflicting_tracts, 'applications' as source from v", ctx=True)
def context_manifest(spark: SparkSession, d: str) -> DataFrame:
    raw = lar(spark, d)
    rows = io.write_context(_context(raw), D.population_conflicts(raw), fresh_path(spark, "context"), {"source": "applications"})
    return rows.select("records", "conflicting_tracts", F.col("parameters")["source"].alias("source"))


@query("select trim(usps) as usps, geoid, aland_sqmi from gaz where usps = '11'", ctx=True)
def gazetteer_text(spark: SparkSession, d: str) -> DataFrame:
    """Land areas of one state from tab-separated text whose names and values carry spaces."""
    path = fresh_path(spark, "gazetteer")
    padded = D.gazetteer(lar(spark, d)).select(F.concat("usps", F.lit(" ")).alias("USPS "), F.concat(F.lit(" "), "geoid").alias("GEOID"), F.concat("aland_sqmi", F.lit("  ")).alias("ALAND_SQMI   "))
    padded.write.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return D.read_gazetteer(spark, path, "11")


@query(_FRONTIER.replace("select release as configuration", ", f as (select release as configuration") .replace("from shown", "from shown)") + f""" select configuration, """ + ", ".join(f"case when coalesce(least(record_count, reference_n, comparison_n) >= {MIN_CELL}, true) then {c} end as {c}" for c in ("is_current_baseline", "record_count", "pre_suppression_uniqueness_rate", "post_suppression_uniqueness_rate", "retained_share", "reference_n", "comparison_n", "utility_estimable", "reference_denial_rate", "minimum_detectable_disparity_points")) + f""",
 case when minimum_detectable_disparity_points is null then 'insufficient_protected_cohort_retention' else 'estimated' end as utility_status, case when least(record_count, reference_n, comparison_n) < {MIN_CELL} then 'suppressed_minimum_cell' end as suppression_status, case when least(record_count, reference_n, comparison_n) < {MIN_CELL} then {MIN_CELL}::bigint end as minimum_cell_size from f""")
def frontier_export(spark: SparkSession, d: str) -> DataFrame:
    """The frontier as an ordered JSON file with small cells redacted, as read back."""
    mart = P.frontier(P.protection_cells(coded(spark, d))).drop("pre_suppression_prosecutor_risk", "suppression_cost_share")
    status = F.when(F.col("minimum_detectable_disparity_points").isNull(), "insufficient_protected_cohort_retention").otherwise("estimated")
    return io.write_mart(mart.withColumn("utility_status", status), fresh_path(spark, "frontier"), [F.col("pre_suppression_uniqueness_rate").desc(), "configuration"])


@query(_FRONTIER.replace("select release as configuration", ", f as (select release as configuration").replace("from shown", "from shown)") + f""" select true as aggregate_only, 0.05e0 as alpha, 0.8e0 as power, 'decision-only two-proportion MDE for each declared release state' as utility_metric,
 'Adjusted fair-lending model remains required for final determination' as limitations, count(*)::bigint as rows, count(*) filter (least(record_count, reference_n, comparison_n) < {MIN_CELL})::bigint as redacted_rows from f""")
def frontier_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What goes with the published frontier."""
    return P.frontier_report(frontier_export(spark, d))


@query(f"select activity_year, derived_race, derived_ethnicity, count(*)::bigint as record_count, sum(is_denied::int)::double / count(is_denied) as denial_rate from app group by 1, 2, 3 having count(*) >= {MIN_CELL}")
def materialized_mart(spark: SparkSession, d: str) -> DataFrame:
    return io.materialize_mart(C.cohort_counts(load(spark, d)), fresh_path(spark, "cohort-counts"))


@query("""select 'customer' as table_name, count(*)::bigint as repeated_keys from (select c_custkey from customer group by 1 having count(*) > 1) union all select 'orders by customer', count(*) from (select o_custkey from orders group by 1 having count(*) > 1)
 union all select 'gazetteer', count(*) from (select trim(geoid) from gaz group by 1 having count(*) > 1) union all select 'tract populations', count(*) from (select census_tract from pop group by 1 having count(*) > 1)""", ctx=True)
def join_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Keys that break a one side of a join, by table: none for customers, gazetteer and populations, many for orders by customer."""
    raw = lar(spark, d)
    tables = {"customer": (spark.read.parquet(f"{d}/customer.parquet"), "c_custkey"), "orders by customer": (spark.read.parquet(f"{d}/orders.parquet"), "o_custkey"), "gazetteer": (D.gazetteer(raw), "geoid"), "tract populations": (D.tract_population(raw), "census_tract")}
    return reduce(DataFrame.union, [D.repeated_keys(df, [k]).agg(F.count("*").alias("repeated_keys")).select(F.lit(n).alias("table_name"), "repeated_keys") for n, (df, k) in tables.items()])


@query()
def bronze_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = io.write_bronze(lar(spark, d).drop("tract_population"), fresh_path(spark, "bronze"), "All Applications")
    return io.manifest(spark, path, {"scope": "all"})


@query("select * from staged where activity_year = 2023 and substr(census_tract, 1, 2) = '11'")
def bronze_slice(spark: SparkSession, d: str) -> DataFrame:
    """One state of one year, read from that year's partition of the bronze layout alone."""
    path = io.write_bronze(lar(spark, d).drop("tract_population"), fresh_path(spark, "bronze"), "All Applications")
    return lar_slice(stage(io.read_bronze(spark, path, [2023], TEXT_COLUMNS)), 2023, state="11")


@query("select activity_year, count(*)::bigint as records, count(income)::bigint as incomes, count(loan_amount) filter (activity_year <> 2021)::bigint as amounts from staged where activity_year between 2020 and 2023 group by 1")
def bronze_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Four years of which one came without loan amounts and with its columns in another order, and one with a column more."""
    path, raw = fresh_path(spark, "bronze"), lar(spark, d).drop("tract_population")
    of = lambda *years: raw.where(F.col("activity_year").isin([str(y) for y in years]))
    io.write_bronze(of(2020, 2022), path, "National")
    for year, rows in ((2021, of(2021).select(*[c for c in reversed(TEXT_COLUMNS) if c != "loan_amount"])), (2023, of(2023).withColumn("rate_spread", F.lit("NA")))):
        rows.write.option("header", True).csv(f"{path}/scope=national/year={year}")
    rows = stage(io.read_bronze(spark, f"{path}/scope=national", [2020, 2021, 2022, 2023], TEXT_COLUMNS, optional=["loan_amount"]))
    return rows.groupBy("activity_year").agg(F.count("*").alias("records"), F.count("income").alias("incomes"), F.count("loan_amount").alias("amounts"))


@query(f", tiers as ({_TIERS_SQL}) select qi_tier, k, count(*)::bigint as classes, sum(k)::bigint as records from tiers group by all")
def bucketed_tier_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The tiers from a silver table in buckets of the demographic fields, which no tier's grouping exchanges again."""
    most = spark.read.parquet(f"{d}/lineitem.parquet").count()  # from the files' footers; an application is a line
    app = io.bucketed(load(spark, d), DEMO_GEO, io.buckets_for(most), "silver")
    parts = [C.k_distribution(C.equivalence_classes(app, f)).withColumn("qi_tier", F.lit(n)) for n, f in TIERS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select 'orders' as table_name, count(*)::bigint as remaining, sum(o_orderkey)::bigint as key_sum, 0::bigint as left_over, true as only_touched_files_changed from orders where o_custkey not in (1, 7, 42) or o_custkey is null")
def subject_file_delete(spark: SparkSession, d: str) -> DataFrame:
    """Three customers' orders deleted from files in order of customers: files without them stay as they are."""
    path = fresh_path(spark, "orders")
    spark.read.parquet(f"{d}/orders.parquet").repartitionByRange(32, "o_custkey").write.parquet(path)
    keys = spark.createDataFrame([(1,), (7,), (42,)], "o_custkey long")
    files = lambda: {r["path"]: (r["length"], r["modificationTime"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length", "modificationTime").collect()}  # noqa: E731  names of files
    before = files()
    touched, kept = G.delete_from_files(spark, path, "o_custkey", keys)
    after = files()
    same = sum(after.get(f) == v for f, v in before.items()) == kept and touched + kept == len(before)
    rows = spark.read.parquet(path)
    gone = rows.join(F.broadcast(keys), "o_custkey", "left_semi").agg(F.count("*").alias("left_over"))  # three keys
    return rows.agg(F.count("*").alias("remaining"), F.sum("o_orderkey").alias("key_sum")).crossJoin(gone).select(F.lit("orders").alias("table_name"), "remaining", "key_sum", "left_over", F.lit(same).alias("only_touched_files_changed"))  # one row each


def _bundled(section: str, source: str, keys: list[str], doubles: list[str], others: list[str]) -> str:
    text = lambda c: f"'{c}=' || coalesce({f'cast(cast(round({c} * 1e9) as decimal(38, 0)) as varchar)' if c in doubles else f'cast({c} as varchar)'}, 'null')"
    return f"select '{section}' as section, concat_ws('|', {', '.join(f'cast({k} as varchar)' for k in keys)}) as key, sha256({' || chr(59) || '.join(text(c) for c in sorted([*keys, *doubles, *others]))}) as sha256 from {source}"


_CELL_DOUBLES = ["sample_uniqueness_rate", "share_records_k_lt_5", "share_records_k_lt_10", "prosecutor_expected_match_risk"]
_BUNDLE = _SCORED + f""", c as (select {_QI}, count(*) as k from app group by {_QI}), metrics as (select derived_race, derived_ethnicity, {_RISK.format(ten=_TEN)} from c group by 1, 2 having sum(k) >= {MIN_CELL}),
cohorts as (select activity_year, derived_race, derived_ethnicity, count(*)::bigint as record_count, sum(is_denied::int)::double / count(is_denied) as denial_rate from app group by 1, 2, 3 having count(*) >= {MIN_CELL}),
dense as (select residential_density_quintile, derived_race, derived_ethnicity, {_REC} from s join res using (census_tract) where derived_ethnicity = 'Not Hispanic or Latino' and derived_race in ('White', 'Black or African American') group by 1, 2, 3 having count(*) >= {MIN_CELL}
 union all select residential_density_quintile, 'ALL', 'ALL', {_REC} from s join res using (census_tract) group by 1 having count(*) >= {MIN_CELL}),
digests as ({_bundled('risk_metrics_by_race', 'metrics', ['derived_race', 'derived_ethnicity'], _CELL_DOUBLES, ['record_count'])} union all {_bundled('risk_cohort_counts', 'cohorts', ['activity_year', 'derived_race', 'derived_ethnicity'], ['denial_rate'], ['record_count'])}
 union all {_bundled('residential_density', 'dense', ['residential_density_quintile', 'derived_race', 'derived_ethnicity'], ['sample_uniqueness_rate', 'prosecutor_expected_match_risk'], ['record_count'])})
select * from digests union all select section, '', sha256(string_agg(sha256, ',' order by key, sha256)) from digests group by 1"""


@query(_BUNDLE, ctx=True)
def release_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the published rows, of the three focal density cohorts, and of each section as a whole."""
    raw, app = bronze(spark, d, TEXT_COLUMNS)
    cohort = ["derived_race", "derived_ethnicity"]
    focal = spark.createDataFrame([("ALL", "ALL"), (WHITE, NON_HISPANIC), (BLACK, NON_HISPANIC)], "derived_race string, derived_ethnicity string")
    return io.bundle({
        "risk_metrics_by_race": (C.class_risk(C.equivalence_classes(app, INSTITUTION), cohort), cohort),
        "risk_cohort_counts": (C.cohort_counts(app), ["activity_year", *cohort]),
        "residential_density": (D.risk_by_residential(app, _context(raw)).join(F.broadcast(focal), cohort, "left_semi"), ["residential_density_quintile", *cohort]),  # three rows
    })


@query()
def release_population_status(spark: SparkSession, d: str) -> DataFrame:
    """One row: whether any fit of population uniqueness can be reported, over how many scenarios."""
    fits = uniqueness.gamma_poisson(C.k_distribution(C.equivalence_classes(load(spark, d), INSTITUTION)))
    edge = F.col("fit_status") == "boundary_fit_not_reportable"
    return fits.agg(F.count("*").alias("scenarios"), F.when(F.bool_and(edge), "boundary_fit_not_reportable").otherwise("review_required").alias("status"))


@query()
def population_uniqueness_subsample(spark: SparkSession, d: str) -> DataFrame:
    return uniqueness.subsample_uniqueness(load(spark, d), INSTITUTION, 0.5)


_U = "('0x' || substr(md5({}), 1, 8))::bigint / 4294967296e0"


@query(f""", c as (select concat_ws('|', {', '.join(f"coalesce({f}, '{M.MISSING}')" for f in DEMO_GEO)}) as class, count(*) as k from app group by {_DEMO}),
e as (select md5(class) as class, k, replicate, unnest(range(1, k + 1)) as i from c, range(1, 31) as r(replicate)), n as (select replicate, class, count(*) as n, max(k) as k from e where {_U.format(f"'{stats.SEED}|' || replicate || '|' || class || '|' || i")} < 0.5 group by 1, 2)
select replicate::int as replicate, count(*)::bigint as draw_unique, count(*) filter (k = 1)::bigint as also_unique from n where n = 1 group by 1""")
def population_uniqueness_md5(spark: SparkSession, d: str) -> DataFrame:
    """The subsampling measure with records drawn one by one, which other engines repeat exactly."""
    return stats.subsample_md5(load(spark, d), DEMO_GEO, 0.5)


_GRID = f"""(select c, i, j, exp(ln(0.03e0) + i * (ln(30e0) - ln(0.03e0)) / 27) as s, c / (exp(ln(0.01e0) + j * (ln(100e0) - ln(0.01e0)) / 31) + c) as q from (select unnest([0.1e0, 0.25e0, 0.5e0]) as c), range(28) as a(i), range(32) as b(j))"""


@query(f""", h as (select k, count(*) as f from (select count(*) as k from app group by {_QI}) group by k)
select c as coverage, i::int as i, j::int as j, round(sum(f * (lgamma(k + s) - lgamma(s) - lgamma(k + 1) + s * ln(1 - q) + k * ln(q) - ln(1 - pow(1 - q, s)))), 3) as log_likelihood from h, {_GRID} group by 1, 2, 3""")
def gamma_poisson_grid(spark: SparkSession, d: str) -> DataFrame:
    """The log-likelihood of the population model over the whole grid that a search begins with."""
    grid = uniqueness.likelihood_grid(C.k_distribution(C.equivalence_classes(load(spark, d), INSTITUTION)))
    return grid.withColumn("log_likelihood", F.round("log_likelihood", 3))


@query()
def gamma_poisson_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return uniqueness.gamma_poisson(C.k_distribution(C.equivalence_classes(load(spark, d), INSTITUTION)))


def _drawn() -> str:
    parts, joins = [], []
    for f in INSTITUTION:
        parts.append(f"h_{f} as (select {f}, sum(count(*)) over (order by substr(md5(coalesce(cast({f} as varchar), '{M.MISSING}')), 1, 2), {f} nulls first) - count(*) as lo, sum(count(*)) over (order by substr(md5(coalesce(cast({f} as varchar), '{M.MISSING}')), 1, 2), {f} nulls first) as hi from app group by {f})")
        parts.append(f"d_{f} as (select record, {f} from (select range as record, floor({_U.format(f"'{stats.SEED}|{f}|' || range")} * (select count(*) from app)) as spot from range(10000)) join h_{f} on spot >= lo and spot < hi)")
        joins.append(f"d_{f}")
    return ", " + ", ".join(parts) + f", drawn as (select record, {_QI} from {joins[0]} " + " ".join(f"join {j} using (record)" for j in joins[1:]) + ")"


@query(_drawn() + " select * from drawn")
def synthetic_auxiliary(spark: SparkSession, d: str) -> DataFrame:
    return stats.synthetic_auxiliary(silver(spark, d), INSTITUTION, 10_000)


_LINKED = ", c as (select {qi}, count(*) as k from app group by {qi}) select count(*)::bigint as synthetic_records, count(k)::double / count(*) as exact_match_rate, count(*) filter (k = 1)::double / count(*) as unique_match_rate, round(coalesce(sum(1e0 / k), 0e0), 9) as expected_correct_matches from drawn left join c on {on}"


@query(_drawn() + _LINKED.format(qi=_QI, on=" and ".join(f"drawn.{f} is not distinct from c.{f}" for f in INSTITUTION)))
def synthetic_linkage(spark: SparkSession, d: str) -> DataFrame:
    app = silver(spark, d)
    return stats.linkage_summary(stats.synthetic_auxiliary(app, INSTITUTION, 10_000), C.equivalence_classes(app, INSTITUTION), INSTITUTION)


@query(_drawn() + _LINKED.format(qi=_DEMO, on=" and ".join(f"drawn.{f} is not distinct from c.{f}" for f in DEMO_GEO)))
def synthetic_linkage_demographic(spark: SparkSession, d: str) -> DataFrame:
    """Linkage on the five demographic fields, where matches are many."""
    app = silver(spark, d)
    return stats.linkage_summary(stats.synthetic_auxiliary(app, DEMO_GEO, 10_000), C.equivalence_classes(app, DEMO_GEO), DEMO_GEO)


@query()
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    return stats.permutation_null(load(spark, d))


@query()
def quintile_permutation(spark: SparkSession, d: str) -> DataFrame:
    raw = lar(spark, d)
    quintiles = D.residential_density(_context(raw)).select("census_tract", F.col("residential_density_quintile").alias("quintile"))
    return stats.quintile_permutation(applications(stage(raw)), quintiles)


_BOOT = " + ".join(f"(u >= {p!r}e0)::int" for p in stats._poisson_steps())


@query(_GS + f""", drawn as (select replicate, nb, nw, ub, uw, {_U.format(f"'{stats.SEED}|' || census_tract || '|' || replicate")} as u from m, range(2000) as r(replicate)),
sums as (select replicate, sum(nb * w) as nb, sum(nw * w) as nw, sum(ub * w) as ub, sum(uw * w) as uw from (select *, {_BOOT} as w from drawn) group by 1), q as (select ub / nb::double / (uw / nw::double) as r from sums where nb > 0 and nw > 0 and uw > 0)
select round(quantile_cont(r, 0.025), 9) as ratio_ci_low, round(quantile_cont(r, 0.975), 9) as ratio_ci_high, count(*)::bigint as usable_replicates from q""")
def size_matched_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap_ratio(M.matched_tracts(M.score_demographic(load(spark, d))))


@query()
def group_size_decision(spark: SparkSession, d: str) -> DataFrame:
    app = load(spark, d)
    tracts = M.matched_tracts(M.score_demographic(app))
    return stats.decision(stats.permutation_null(app), M.size_matched_ratio(tracts), stats.bootstrap_ratio(tracts))


@query()
def adjusted_disparity(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted models of the four configurations, a row each, with the shares of records that lie on common support."""
    cells = io.materialize_mart(P.modeling_cells(coded(spark, d)), fresh_path(spark, "modeling-cells"))
    fitted = logistic.adjusted_disparity(cells, names=[p.name for p in PROTECTIONS])
    return fitted.join(F.broadcast(M.common_support(cells)), "configuration", "left")  # a row for each configuration


@query(f"""select derived_race, derived_ethnicity, greatest(round(n - sign(u) * ln(1 - 2 * abs(u) * (1 - 1e-12))), 0)::bigint as record_count from (select derived_race, derived_ethnicity, count(*) as n,
 {_U.format(f"'{stats.SEED}|' || coalesce(derived_race, '{M.MISSING}') || '|' || coalesce(derived_ethnicity, '{M.MISSING}')")} - 0.5e0 as u from app group by 1, 2)""")
def dp_group_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d).groupBy("derived_race", "derived_ethnicity").agg(F.count("*").alias("record_count"))
    return stats.noised_counts(counts, "record_count", 1.0, ["derived_race", "derived_ethnicity"])
