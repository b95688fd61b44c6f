import hashlib
import math
import pathlib
from collections import Counter
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark import classes as C
from riskspark import density as D
from riskspark import governance as G
from riskspark import io
from riskspark import measures as M
from riskspark import protection as P
from riskspark import logistic, stats, uniqueness
from riskspark.config import ProtectionConfig, QIConfig


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("1", "25-34", "A"), ("1", "25-34", "A"), ("2", "35-44", "B"), ("3", "45-54", "C")], "tract string, age string, race string")


def test_classes_and_summary(people):
    classes = C.equivalence_classes(people, ["tract", "age"])
    assert sorted(r.k for r in classes.collect()) == [1, 1, 2]
    s = C.risk_summary(classes).first()
    assert (s.record_count, s.sample_unique_records, s.sample_uniqueness_rate, s.prosecutor_expected_match_risk) == (4, 2, 0.5, 0.75)
    assert C.risk_summary(classes.where("false")).first().prosecutor_expected_match_risk == 0


def test_cohorts_use_the_complete_universe(people, spark):
    assert [r.race for r in C.cohort_risk(people, ["tract", "age"], ["race"], 2).collect()] == ["A"]
    assert C.cohort_risk(people, ["tract", "age"], ["race"], 3).count() == 0
    rows = spark.createDataFrame([("1", "x", "A"), ("1", "x", "B"), ("2", "y", "A"), ("2", "y", "B")], "tract string, age string, cohort string")
    assert C.cohort_risk(rows, ["tract", "age"], ["cohort"], 1).where("cohort = 'A'").first().sample_uniqueness_rate == 0
    assert C.cohort_risk(rows.where("cohort = 'A'"), ["tract", "age"], ["cohort"], 1).first().sample_uniqueness_rate == 1


def test_guards(people):
    with pytest.raises(ValueError):
        C.equivalence_classes(people, ["tract", "income"])
    with pytest.raises(ValueError):
        C.guard(people.withColumn("uli", F.lit("x")), ["tract"])
    with pytest.raises(ValueError):
        QIConfig(fields=("uli",))
    with pytest.raises(ValueError):
        C.cohort_risk_report(people, ["tract"], ["race"], "one_county")
    for bad in ({"geography": "block"}, {"income_band": 0}, {"suppress_k_below": 1}):
        with pytest.raises(ValueError):
            ProtectionConfig("x", **bad)


def test_null_keys_are_one_class(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), ("1", None)], "tract string, age string")
    assert sorted(r.k for r in C.score_k(df, ["tract", "age"]).collect()) == [1, 2, 2]


def test_bands_and_geography(spark):
    df = spark.createDataFrame([("49999", "1001020100.0"), ("50000", "48201310100"), (None, None)], "x string, t string")
    got = df.select(P.band_label(F.col("x"), 50000).alias("b"), *[P.generalize_geography(F.col("t"), g).alias(g) for g in ("tract", "county", "state", "national")]).collect()
    assert [tuple(r) for r in got] == [("0-50000", "01001020100", "01001", "01", "US"), ("50000-100000", "48201310100", "48201", "48", "US"), (None,) * 5]


def test_protection_keeps_large_classes(spark):
    df = spark.createDataFrame([("48201310100", 30000.0, 60000.0), ("48201310200", 40000.0, 90000.0), ("48201310200", 90000.0, 90000.0)], "census_tract string, income double, loan_amount double")
    p = ProtectionConfig("c", "county", 25000, 50000, 2)
    assert P.apply_protection(df, p, ["census_tract", "income", "loan_amount"]).count() == 2


def test_diversity(spark):
    df = spark.createDataFrame([("1", 0), ("1", 1), ("2", 0), ("2", 0)], "tract string, denied int")
    c = M.class_diversity(df, ["tract"], "denied", 2)
    assert c.where("tract = '1'").first().l_distinct == 2
    s = M.diversity_summary(c).first()
    assert (s.records_failing_l, s.records_failing_t) == (2, 4)
    with pytest.raises(ValueError):
        M.diversity_summary(c, t_threshold=1.5)


def test_redaction_and_retention(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 30, 0.5)], "configuration string, comparison_n int, rate double")
    rows = {r.configuration: r for r in G.redact(df).collect()}
    assert rows["a"].rate is None and rows["a"].suppression_status == "suppressed_minimum_cell" and rows["b"].rate == 0.5
    with pytest.raises(ValueError):
        G.redact(df, 1)
    t = spark.sql("select timestamp '2024-01-26 00:00:00' as c union all select timestamp '2024-01-20 00:00:00'")
    at = datetime(2024, 1, 31, tzinfo=UTC)
    assert sorted(r.expired for r in G.retention(t, "c", at, 10).collect()) == [False, True]
    with pytest.raises(ValueError):
        G.retention(t, "c", datetime(2024, 1, 31), 10)


def test_subject_rights(spark):
    key = f"{G.SUBJECT_KEY} string"
    tables = {"control": spark.createDataFrame([("S1", 1), ("S2", 2)], key + ", v int"), "events": spark.createDataFrame([("S1", 1), ("S1", 2), (None, 3)], key + ", e int"), "totals": spark.createDataFrame([(5,)], "n int")}
    keys = spark.createDataFrame([("S1",)], key)
    _, audit = G.subject_export(tables, keys)
    assert sorted((r.table_name, r.records) for r in audit.collect()) == [("control", 1), ("events", 2)]
    kept, _ = G.subject_delete(tables, keys)
    assert [r[0] for r in kept["control"].collect()] == ["S2"] and kept["events"].count() == 1 and kept["totals"].count() == 1


def fitted(spark, sizes, counts, *coverages):
    return [r for r in uniqueness.gamma_poisson(spark.createDataFrame([(int(k), int(n)) for k, n in zip(sizes, counts, strict=True)], "k long, classes long"), coverages).collect()]


def test_gamma_poisson(spark):
    small = [r.population_unique_probability for r in fitted(spark, [1, 2, 3, 4], [100, 40, 20, 10], 0.1, 0.5)]
    assert 0 <= small[0] < small[1] <= 1
    assert fitted(spark, [1, 10], [10000, 100], 0.25)[0].fit_status == "boundary_fit_not_reportable"
    rng = np.random.default_rng(1)
    cells = rng.gamma(0.7, 1 / 0.35, 30_000)
    seen, rest = rng.poisson(cells * 0.25), rng.poisson(cells * 0.75)
    k, n = np.unique(seen[seen > 0], return_counts=True)
    r = fitted(spark, k, n, 0.25)[0]
    assert abs(r.population_unique_probability - ((seen == 1) & (rest == 0)).sum() / (seen == 1).sum()) < 0.04

    def likelihood(shape, rate, c=0.25):  # of a plain sum over classes
        none = shape * math.log(rate / (rate + c))
        each = [math.lgamma(x + shape) - math.lgamma(shape) - math.lgamma(x + 1) + none + x * math.log(c / (rate + c)) - math.log(-math.expm1(none)) for x in k]
        return float(np.dot(each, n))

    assert r.log_likelihood == pytest.approx(likelihood(r.gamma_shape, r.gamma_rate), abs=1e-6)
    assert all(likelihood(r.gamma_shape * math.exp(a), r.gamma_rate * math.exp(b)) < r.log_likelihood for a, b in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3), (1e-3, 1e-3), (-1e-3, -1e-3)))


def test_log_gamma(spark):
    points = [1e-4, 0.03, 0.5, 1.0, 1.5, 2.0, 7.25, 30.0, 1e3, 1e6, 1e7, 1e12]
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in points], "x double").select("x", uniqueness.log_gamma(F.col("x")).alias("y")).collect()}
    for x in points:
        assert got[x] == pytest.approx(math.lgamma(x), rel=1e-13, abs=5e-14)


def test_random_jobs_do_not_depend_on_partitions(spark):
    rows = [(str(i % 9), str(i % 3), "AB"[i % 2], "White" if i % 3 else "Black or African American", "Not Hispanic or Latino") for i in range(300)]
    df = spark.createDataFrame(rows, "census_tract string, applicant_age string, applicant_sex string, derived_race string, derived_ethnicity string")
    a, b = df.repartition(1), df.repartition(7)
    assert stats.permutation_null(a, 40).collect() == stats.permutation_null(b, 40).collect()
    f = ["census_tract", "applicant_age", "derived_race"]
    for leaf in (4096, 2):  # one leaf, and a tree of several levels
        assert uniqueness.subsample_uniqueness(a, f, 0.5, 40, leaf=leaf).collect() == uniqueness.subsample_uniqueness(b, f, 0.5, 40, leaf=leaf).collect()


def test_adjusted_model(spark):
    rng = np.random.default_rng(2)
    b = rng.integers(0, 2, 1500)
    y = rng.random(1500) < 1 / (1 + np.exp(1 - 0.65 * b))
    rows = [(int(i), int(j), float(x), 100000.0, *["a" if x > 40 else "b"] * 9) for i, j, x in zip(b, y, rng.uniform(20, 90, 1500), strict=True)]
    df = spark.createDataFrame(rows, "is_black int, is_denied int, protected_income double, protected_loan_amount double, " + ", ".join(f"{c} string" for c in (*logistic.CATEGORICAL, logistic.AREA)))
    r = logistic.adjusted_disparity(df).first()
    assert r.converged and r.odds_ratio_ci_low < np.exp(0.65) < r.odds_ratio_ci_high
    assert logistic.adjusted_disparity(df.where("is_black = 0")).first().status == "insufficient_retained_comparison"


def test_adjusted_disparity_has_every_configuration(spark):
    from riskspark import queries
    from riskspark.config import PROTECTIONS

    got = queries.QUERIES["adjusted_disparity"](spark, "/root/testdata/sf0.001")
    assert sorted(r.configuration for r in got.collect()) == sorted(p.name for p in PROTECTIONS)


def test_permutation_null_draws_tables_from_counts(spark):
    black, white, hispanic = ("Black or African American", "Not Hispanic or Latino"), ("White", "Not Hispanic or Latino"), ("White", "Hispanic or Latino")
    rows = [("t", str(i % 7), "1", *[black, white, white, hispanic][i * i % 11 % 4]) for i in range(45)]
    df = spark.createDataFrame(rows, "census_tract string, applicant_age string, applicant_sex string, derived_race string, derived_ethnicity string")
    got = stats.permutation_null(df, 1000).first()
    rng = np.random.default_rng(5)
    labels, ratios = [r[3:] for r in rows], []
    size = [sum(x == y for x in labels) for y in (black, white)]
    for _ in range(4000):
        mixed = [(rows[i][1], labels[j]) for i, j in enumerate(rng.permutation(len(rows)))]
        count = Counter(mixed)
        u = [sum(v == 1 for (_, x), v in count.items() if x == y) for y in (black, white)]
        if u[1]:
            ratios.append(u[0] / size[0] / (u[1] / size[1]))
    assert abs(got.null_mean - np.mean(ratios)) < 5 * np.std(ratios) / np.sqrt(800)
    assert abs(got.null_sd / np.std(ratios) - 1) < 0.25
    copies = df.crossJoin(spark.range(20_000).select())  # 900,000 records of one tract
    counts = stats.permutation_counts(copies)
    assert counts.count() <= 7 * 3 and counts.agg(F.sum("n")).first()[0] == 900_000
    assert stats.permutation_null(copies, 100).first().iterations == 0  # no record is unique


def test_release_risk_takes_all_quasi_identifiers(spark):
    from riskspark import queries
    from riskspark.config import INSTITUTION

    sf = "/root/testdata/sf0.001"
    assert set(INSTITUTION) <= set(queries.QUERIES["synthetic_auxiliary"](spark, sf).columns)
    classes = C.equivalence_classes(queries.load(spark, sf), INSTITUTION).count()
    assert {r.observed_equivalence_classes for r in queries.QUERIES["gamma_poisson_uniqueness"](spark, sf).collect()} == {classes}


def test_gamma_poisson_needs_two_classes(spark):
    for sizes, counts in (([1], [1]), ([0, 1], [3, 3])):
        with pytest.raises(ValueError):
            fitted(spark, sizes, counts, 0.5)


def test_subsampling_draws_like_shuffled_records(spark):
    k = [1] * 300 + [2] * 80 + [3] * 40 + [9] * 5
    rows = [(f"c{i}",) for i, n in enumerate(k) for _ in range(n)]
    df = spark.createDataFrame(rows, "tract string")
    got = [uniqueness.subsample_uniqueness(df, ["tract"], 0.4, 400, leaf=leaf).first() for leaf in (4096, 8)]
    assert got[0].sample_unique_records == 300 and got[0].estimated_population_unique_records == pytest.approx(300 * got[0].mean_share, abs=1e-4)
    with pytest.raises(ValueError):
        uniqueness.subsample_uniqueness(df, ["tract"], 1.0)
    rng, owner, shares = np.random.default_rng(7), np.repeat(np.arange(len(k)), k), []
    for _ in range(2000):
        n = np.bincount(owner[rng.permutation(len(owner))[: round(0.4 * len(owner))]], minlength=len(k))
        shares.append((n[:300] == 1).sum() / (n == 1).sum())
    for r in got:
        assert abs(r.mean_share - np.mean(shares)) < 5 * np.std(shares) / np.sqrt(350) and abs(r.sd_share / np.std(shares) - 1) < 0.25


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "quintile int, p_value double")
    assert [r.holm_p_value for r in stats.holm(df).orderBy("quintile").collect()] == [0.04, 0.09, 0.09, 0.5]


def test_schema_drift_and_finite(spark):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, None)], "record_count int, rate double")
    assert [r.rate for r in G.finite(df).orderBy("record_count").collect()] == [0.5, None, None, None, None]
    assert G.schema_drift(df, {"record_count": "public", "rate": "secret"}, ["public"]) == [("rate", "invalid")]
    assert G.schema_drift(df, {"rate": "public"}, ["public"]) == [("record_count", "missing")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(str(2018 + i % 2), f"x{i}") for i in range(20)], "activity_year string, lei string")
    assert io.slug("All Applications, TX!") == "all-applications-tx"
    path = io.write_bronze(df, str(tmp_path), "All Applications")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        io.write_bronze(df, str(tmp_path), "all applications")
    for r in io.manifest(spark, path, {"scope": "all"}).collect():
        data = pathlib.Path(r.path.removeprefix("file:")).read_bytes()
        assert (r.sha256, r.bytes, r.parameters) == (hashlib.sha256(data).hexdigest(), len(data), {"scope": "all"})
    mart = spark.createDataFrame([("a", 5, 0.5), ("b", 50, float("nan")), ("c", 90, 0.25)], "configuration string, record_count long, rate double")
    back = io.write_mart(mart, f"{tmp_path}/mart", [F.col("record_count").desc()])
    assert [r.configuration for r in back.collect()] == ["c", "b", "a"]
    assert {r.configuration: (r.record_count, r.rate, r.suppression_status) for r in back.collect()} == {"a": (None, None, "suppressed_minimum_cell"), "b": (50, None, None), "c": (90, 0.25, None)}


def test_one_side_of_a_join(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, v int")
    assert sorted(((r.k, r.rows) for r in D.repeated_keys(df, ["k"]).collect()), key=str) == [("a", 2), (None, 2)]
    assert D.require_unique(df, ["k", "v"]) is df
    with pytest.raises(ValueError):
        D.require_unique(df, ["k"])


def test_roll_up_equals_protection_of_records(spark):
    from riskspark import queries

    app = queries.load(spark, "/root/testdata/sf0.001")
    for p, n in P.rolled(app, P.PROTECTIONS)[0]:
        direct = C.k_distribution(C.equivalence_classes(P.protected(app, p), P.INSTITUTION))
        again = n.groupBy("k").agg(F.sum("k").alias("records"))
        assert sorted((r.k, r.records) for r in direct.collect()) == sorted((r.k, r.records) for r in again.collect())
    assert P.nests(P.PROTECTIONS[2], P.PROTECTIONS[3]) and not P.nests(P.PROTECTIONS[3], P.PROTECTIONS[2])
