"""Mechanisms for scale: plans, hot keys, and results against plain versions."""

import hashlib
import pathlib
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark import density as D
from riskspark import governance as G
from riskspark import io, logistic, queries, uniqueness
from riskspark import protection as P
from riskspark.classes import equivalence_classes, tier_profiles
from riskspark.config import DEMO_GEO, TIERS
from riskspark.lar import TEXT_COLUMNS, load
from riskspark.ranking import exact_percentile, ntile, ranked

SF = "/root/testdata/sf0.001"


def plan(df):
    """The physical plan without what adaptive execution adds to it."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def dense_fit(df):
    """The whole design in one matrix, geography dummies and all."""
    x = [np.ones(len(df)), df["is_black"].to_numpy(float)]
    for c in logistic.CONTINUOUS:
        v = np.log1p(df[c].clip(lower=0).to_numpy(float))
        v = np.where(np.isnan(v), np.nanmedian(v), v)
        x.append((v - v.mean()) / v.std())
    for c in (*logistic.CATEGORICAL, logistic.AREA):
        d = pd.get_dummies(df[c].fillna("Missing"), drop_first=True, dtype=float)
        x += list(d.to_numpy().T)
    x, y = np.column_stack(x), df["is_denied"].to_numpy(float)
    beta, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1e-8] * (x.shape[1] - 1))
    for k in range(1, 101):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x.T * np.maximum(p * (1 - p), 1e-9)) @ x + ridge
        step = np.linalg.solve(h, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    h = (x.T * np.maximum(p * (1 - p), 1e-9)) @ x + ridge
    return beta[1], np.sqrt(np.linalg.inv(h)[1, 1]), k, x.shape[1]


def applications(areas, n, seed=1):
    rng = np.random.default_rng(seed)
    area = rng.integers(0, areas, n)
    area[rng.random(n) < 0.33] = 7  # a third in one area
    black, income, amount, age = rng.integers(0, 2, n), rng.integers(10, 300, n) * 1000.0, rng.integers(5, 90, n) * 10000.0, rng.integers(0, 5, n)
    income[rng.random(n) < 0.05] = np.nan
    odds = -0.4 + 0.5 * black + rng.normal(0, 0.3, areas)[area] - 0.2 * (np.log1p(np.nan_to_num(income, nan=50_000)) - 11) + 0.1 * age
    denied = rng.random(n) < 1 / (1 + np.exp(-odds))
    same = dict.fromkeys(("applicant_sex", "loan_type", "debt_to_income_ratio", "loan_purpose", "occupancy_type", "lien_status", "derived_dwelling_category"), "1")
    return pd.DataFrame({"is_black": black.astype("int32"), "is_denied": denied.astype("int32"), "protected_geography": [f"{a:011d}" for a in area], "protected_income": income, "protected_loan_amount": amount, "applicant_age": age.astype(str), **same})


@pytest.mark.parametrize(("areas", "n"), [(60, 3000), (5000, 25_000)])  # sums on the driver, and in tables
def test_wide_models_equal_a_dense_fit(spark, areas, n):
    df = applications(areas, n)
    b, se, steps, columns = dense_fit(df) if areas < 1000 else sparse_fit(df)
    rows = df.astype({"protected_income": object}).where(df.notna(), None)
    got = logistic.adjusted_disparity(spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c.startswith('is_') else 'double' if c in logistic.CONTINUOUS else 'string'}" for c in rows.columns)).repartition(4)).first()
    assert columns > 0.9 * areas * (1 - 1 / 400) and got.converged and abs(got.iterations - steps) <= 1
    assert got.adjusted_log_odds_coefficient == pytest.approx(b, abs=1e-7)
    assert np.log(got.odds_ratio_ci_high / got.adjusted_odds_ratio) / 1.96 == pytest.approx(se, rel=1e-6)


def sparse_fit(df):
    """The same fit of thousands of columns with records collapsed by area codes: normal equations by bincount, solved densely."""
    codes = pd.factorize(df["protected_geography"], sort=True)[0]
    base = df.drop(columns="protected_geography").assign(protected_geography="x")
    x = [np.ones(len(base)), base["is_black"].to_numpy(float)]
    for c in logistic.CONTINUOUS:
        v = np.log1p(base[c].clip(lower=0).to_numpy(float))
        v = np.where(np.isnan(v), np.nanmedian(v), v)
        x.append((v - v.mean()) / v.std())
    x += list(pd.get_dummies(base["applicant_age"], drop_first=True, dtype=float).to_numpy().T)
    x, y, m, q = np.column_stack(x), base["is_denied"].to_numpy(float), codes.max(), 0
    q = x.shape[1]
    beta = np.zeros(q + m)
    ridge = np.array([0.0] + [1e-8] * (q + m - 1))

    def equations():
        p = 1 / (1 + np.exp(-np.clip(x @ beta[:q] + np.concatenate([[0.0], beta[q:]])[codes], -30, 30)))
        w, r = np.maximum(p * (1 - p), 1e-9), y - p
        h = np.zeros((q + m, q + m))
        h[:q, :q] = (x.T * w) @ x
        for j in range(q):
            h[j, q:] = h[q:, j] = np.bincount(codes, w * x[:, j], m + 1)[1:]
        h[np.arange(q, q + m), np.arange(q, q + m)] = np.bincount(codes, w, m + 1)[1:]
        h[np.arange(q + m), np.arange(q + m)] += ridge
        return h, np.concatenate([x.T @ r, np.bincount(codes, r, m + 1)[1:]]) - ridge * beta

    for k in range(1, 101):
        step = np.linalg.solve(*equations())
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta[1], np.sqrt(np.linalg.solve(equations()[0], np.eye(q + m)[:, :2])[1, 1]), k, q + m


def test_ranks_and_groups_over_ranges(spark):
    rng = np.random.default_rng(4)
    values = [None if x == 0 else int(x) for x in rng.integers(0, 40, 1003)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(6)
    order = sorted(range(1003), key=lambda i: (values[i] is not None, values[i] or 0, i))
    out, n = ranked(df, ["v", "i"])
    assert n == 1003 and [r.i for r in out.orderBy("rank").collect()] == order and out.select("rank").distinct().count() == 1003
    for groups in (5, 7, 1003, 2000):
        got = {r.i: r.g for r in ntile(df, groups, ["v", "i"], "g").collect()}
        size, larger = divmod(1003, groups)
        want = [g + 1 for g in range(groups) for _ in range(size + (g < larger))]
        assert [got[i] for i in order] == want
    assert ntile(df.where("false"), 5, ["v", "i"], "g").count() == 0


def test_percentile_of_a_key_with_very_many_values(spark):
    rng = np.random.default_rng(6)
    rows = [("hot", float(x)) for x in rng.normal(size=20_001)] + [("hot", None)] * 10 + [(f"t{i}", float(x)) for i in range(50) for x in rng.integers(0, 6, i)] + [(None, 2.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "t string, v double").repartition(5)
    by = {}
    for t, v in rows:
        if v is not None:
            by.setdefault(t, []).append(v)
    got = {r.t: r.m for r in exact_percentile(df, ["t"], "v", 0.5, "m").collect()}
    assert got == {t: pytest.approx(statistics.median(v)) for t, v in by.items()}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        ninth = {r.t: r.m for r in exact_percentile(df, ["t"], "v", 0.9, "m").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert ninth == {t: pytest.approx(float(np.quantile(v, 0.9))) for t, v in by.items()}


def test_density_plans_have_no_single_task(spark):
    app = load(spark, SF)
    for q in (D.release_density(app), queries.QUERIES["tract_residential_density"](spark, SF)):
        assert "SinglePartition" not in plan(q)


def test_one_exchange_for_each_configuration(spark):
    app = queries.silver(spark, SF)
    for i, (_, classes) in enumerate(P.rolled(app, P.PROTECTIONS)[0]):
        found = plan(classes)
        assert found.count("Exchange hashpartitioning") == i + 1 and "Window" not in found  # its own, and those of the ones it is rolled up from
        assert found.count("partial_sum") + found.count("partial_count") > 0


def test_hot_classes_are_counted_before_they_are_dealt(spark):
    app = load(spark, SF)
    hot = app.union(app.limit(1).crossJoin(spark.range(20_000).select()))  # most records in one class
    for df in (equivalence_classes(hot, DEMO_GEO), *tier_profiles(hot).values(), D.risk_by_residential(hot, queries._context(queries.lar(spark, SF)))):
        found = plan(df)
        assert "Window" not in found and "partial_count" in found
    p = P.ProtectionConfig("x", "county", 25_000, 50_000, 5)
    kept = P.apply_protection(hot, p)
    assert "Window" not in plan(kept)
    classes = P.rolled(hot, [p])[0][0][1]
    assert kept.count() == classes.where("k >= 5").agg(F.sum("k")).first()[0]


def test_digests_of_files_in_pieces(spark, tmp_path):
    texts = {"part-a.csv": b"a,b\n1,2\n" * 300_000, "part-b.csv": b"no line feed at the end", "part-c.csv": b"x", "part-d.csv": b"\n\n\n", "part-e.csv": bytes(range(256)) * 20_000, "part-f.csv": b"\r\nx\r\n"}
    for name, data in texts.items():
        pathlib.Path(tmp_path, name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")  # files of many splits
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.bytes) for r in io.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in texts.items()}


def test_slices_read_their_partition_alone(spark):
    assert "PartitionFilters: [isnotnull(year" in plan(queries.QUERIES["bronze_slice"](spark, SF)) or "PartitionFilters: [year" in plan(queries.QUERIES["bronze_slice"](spark, SF))


def test_years_that_lack_a_column_are_refused(spark, tmp_path):
    raw = load(spark, SF).select(*[F.col(c).cast("string").alias(c) for c in TEXT_COLUMNS])
    raw.where("activity_year = 2020").drop("lei").write.option("header", True).csv(f"{tmp_path}/year=2020")
    with pytest.raises(ValueError, match="lei"):
        io.read_bronze(spark, str(tmp_path), [2020], TEXT_COLUMNS)
    assert io.read_bronze(spark, str(tmp_path), [2020], TEXT_COLUMNS, optional=["lei"]).where("lei is not null").count() == 0


def test_buckets_spare_every_exchange(spark):
    app = io.bucketed(load(spark, SF), DEMO_GEO, 4, "silver_test")
    for fields in TIERS.values():
        assert "Exchange" not in plan(equivalence_classes(app, fields))


def test_deletion_touches_only_files_with_a_key(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).select(F.when(F.col("id") == 500, None).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v")).repartitionByRange(10, "k").write.parquet(path)
    bytes_of = lambda: {f.name: f.read_bytes() for f in pathlib.Path(path).glob("part-*")}
    before = bytes_of()
    keys = spark.createDataFrame([(3,), (5,), (999,)], "k long")
    touched, kept = G.delete_from_files(spark, path, "k", keys)
    after = bytes_of()
    assert touched in (1, 2) and touched + kept == len(before) and sum(after.get(n) == b for n, b in before.items()) == kept
    assert sorted(r.k for r in spark.read.parquet(path).where("k is not null").collect()) == [i for i in range(1000) if i not in (3, 5, 500, 999)]
    assert spark.read.parquet(path).where("k is null").count() == 1
    assert G.delete_from_files(spark, path, "k", keys) == (0, len(after)) and bytes_of() == after


def test_a_deletion_cut_short_is_finished(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(100).withColumnRenamed("id", "k").repartitionByRange(5, "k").write.parquet(path)
    keys = spark.createDataFrame([(1,)], "k long")
    files = G.files_with(spark, path, "k", keys)
    spark.read.parquet(*files).where("k <> 1").write.parquet(f"{path}/_deletion")
    spark.createDataFrame([(f,) for f in files], "value string").coalesce(1).write.text(f"{path}/_replaced")
    assert spark.read.parquet(path).count() == 100  # not begun to move
    G.finish_deletion(spark, path)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [0, *range(2, 100)] and not list(pathlib.Path(path).glob("_de*"))


def test_all_marts_in_order_go_on_where_they_stopped(spark, tmp_path):
    from riskspark.run_all import MARTS, run_all

    assert set(MARTS) <= set(queries.QUERIES)
    some = ("risk_cohort_counts", "class_diversity")
    first = run_all(spark, SF, str(tmp_path), some).collect()
    pathlib.Path(tmp_path, "class_diversity", "_SUCCESS").unlink()
    kept = pathlib.Path(tmp_path, "risk_cohort_counts", "_SUCCESS").stat().st_mtime_ns
    assert run_all(spark, SF, str(tmp_path), some).collect() == first and first[0].rows > 0
    assert pathlib.Path(tmp_path, "risk_cohort_counts", "_SUCCESS").stat().st_mtime_ns == kept


def test_draws_are_dealt_by_leaves_not_by_bytes(spark, monkeypatch):
    dealt = []
    kind = type(spark.range(1))
    one = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda df, *a, **b: dealt.append(df.rdd.getNumPartitions()) or one(df, *a, **b))
    uniqueness.subsample_uniqueness(spark.range(3000).withColumn("x", F.col("id") % 1700), ["x"], 0.5, replicates=30, leaf=16)
    assert dealt == [128 // uniqueness.TASK_LEAVES]  # 1,700 classes in 128 leaves


def test_buckets_grow_with_the_table(spark):
    assert [io.buckets_for(n) for n in (0, 600_000, 36_000_000, 216_000_000)] == [16, 16, 72, 432]


def test_the_bundle_joins_its_applications_once(spark):
    assert "l_orderkey" not in plan(queries.QUERIES["release_bundle"](spark, SF))  # all sections read the written table


def test_checks_sum_up_the_modeling_cohort_once(spark, monkeypatch):
    calls, one = [], P.modeling_cells
    monkeypatch.setattr(P, "modeling_cells", lambda *a: calls.append(1) or one(*a))
    queries.QUERIES["quality_checks"](spark, SF)
    assert len(calls) == 1  # published and planted rows read the written cells
