import pytest
from conftest import SF
from pyspark.sql import functions as F

from riskspark import protection as P
from riskspark import queries
from riskspark.config import INSTITUTION, PROTECTIONS
from riskspark.lar import TABLES, VOCABULARIES, coded, load
from test_mechanisms import plan

FIELDS = [*INSTITUTION, "action_taken"]


def same_records(spark, d):
    packed = coded(spark, d)
    one, other = (df.select(*FIELDS).groupBy(*FIELDS).count() for df in (packed.unpacked(packed.rows), load(spark, d)))
    assert one.count() > 50 and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    assert {r[0] for r in load(spark, d).select("action_taken").distinct().collect()} <= set(packed.actions)


def test_coded_records_are_the_applications(spark):
    same_records(spark, SF)


def test_coded_records_on_odd_inputs(spark, tmp_path):
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        keys = [c for c in df.columns if c in ("l_orderkey", "o_orderkey", "p_partkey", "n_nationkey")]
        rare = lambda c: F.pmod(F.xxhash64(F.lit(c), *keys or ["c_custkey"], *(["l_linenumber"] if t == "lineitem" else [])), F.lit(13)) == 0  # noqa: B023, E731
        odd = df.select(*[F.when(~rare(c), F.col(c)).alias(c) for c in df.columns])
        if t == "lineitem":  # the first and last moments of the years, actions and amounts that aren't on the list
            edges = F.array(*[F.lit(x).cast(df.schema["l_shipdate"].dataType) for x in ("1995-12-31 23:59:59.999999", "1996-01-01", "2003-12-31 23:59:59.999999", "2004-01-01")])
            odd = odd.withColumns({"l_shipdate": F.when(F.col("l_orderkey") % 3 == 0, edges[F.pmod(F.hash("l_partkey", "l_suppkey"), F.lit(4))]).otherwise(F.col("l_shipdate")),
                                   "l_suppkey": F.when(F.col("l_orderkey") % 7 == 0, -F.col("l_suppkey")).otherwise(F.col("l_suppkey")), "l_linenumber": F.when(F.col("l_orderkey") % 11 == 0, -5).otherwise(F.col("l_linenumber")),
                                   "l_extendedprice": F.when(F.col("l_orderkey") % 5 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))})
        odd.write.parquet(f"{tmp_path}/{t}.parquet")
    same_records(spark, str(tmp_path))
    for f in (P.protection_cells, P.protection_classes, P.modeling_cells):
        a, b = (sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (f(coded(spark, str(tmp_path))), f(load(spark, str(tmp_path)))))
        assert a == b and a


def test_joins_have_more_tasks_for_larger_tables(spark, monkeypatch):
    assert "REPARTITION_BY_NUM" not in plan(coded(spark, SF).rows)
    monkeypatch.setattr("riskspark.lar.JOIN_ROWS", 100)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    found = plan(coded(spark, SF).rows)
    assert f", {-(-rows // 100)}), REPARTITION_BY_NUM" in found
    same_records(spark, SF)


def test_classes_are_dealt_by_numbers(spark):
    """No text of a closed vocabulary is sorted, summed or dealt before classes are made."""
    packed = coded(spark, SF)
    found = plan(P.rolled(packed, PROTECTIONS)[0][-1][1].drop(*VOCABULARIES))
    assert found.count("Exchange hashpartitioning(census_tract") == len(PROTECTIONS) and "profile" in found
    assert not any(f"{c}#" in line for line in found.splitlines() if "Exchange" in line for c in VOCABULARIES)
    for name in ("protection_utility_cells", "protection_equivalence_classes", "common_support", "fair_lending_cohort_counts"):
        assert "lineitem_digits" in plan(queries.QUERIES[name](spark, SF))


def test_tasks_of_sums_and_joins_grow_in_number_with_the_table(spark, monkeypatch):
    """No exchange of records, classes or cells is left at Spark's number of partitions, and many parts are not sent to every task."""
    names = ("common_support", "fair_lending_cohort_counts", "protection_utility_cells")
    few = {n: sorted(queries.QUERIES[n](spark, SF).collect()) for n in names}
    monkeypatch.setattr("riskspark.lar.JOIN_ROWS", 400)
    monkeypatch.setattr("riskspark.lar.PART_ROWS", 10)
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 400)
    for n in names:
        df = queries.QUERIES[n](spark, SF)
        dealt = [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]
        left = [line for line in dealt if f", {tasks})" not in line]
        assert len(dealt) > 8 and len(left) == 1 and "hashpartitioning(configuration#" in left[0] and "protected_geography" not in left[0]  # the last sums: a row a task for each cohort
        assert [line for line in plan(df).splitlines() if "Join [l_partkey" in line and "SortMergeJoin" not in line] == []
        assert sorted(df.collect()) == few[n] != []


def test_records_of_wanted_values_alone(spark):
    packed = coded(spark, SF, only=P.FOCAL)
    app = load(spark, SF).where(F.col("derived_race").isin(*P.FOCAL["derived_race"]) & F.col("derived_ethnicity").isin(*P.FOCAL["derived_ethnicity"]))
    one, other = (df.select(*FIELDS).groupBy(*FIELDS).count() for df in (packed.unpacked(packed.rows), app))
    assert one.count() > 50 and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    for only in ({"loan_type": ("2",)}, {"lei": (None, "LEI009"), "applicant_age": ("<25",)}):
        part = coded(spark, SF, only=only)
        rows = load(spark, SF).where(" and ".join(f"array_contains(array({', '.join(repr(v) for v in values if v)}), {f})" for f, values in only.items())).count()
        assert part.rows.count() == rows > 0
    with pytest.raises(ValueError, match="not packed"):
        coded(spark, SF, only={"income": ("1",)})


def test_packed_covariates_give_the_cells_of_texts(spark):
    packed = P.modeling_classes(coded(spark, SF), packed=True)
    texts = P.modeling_classes(load(spark, SF))
    a, b = (df.groupBy(*[c for c in df.columns if c not in ("n", "is_black", "is_denied")]).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_black")).alias("x")).groupBy("configuration", "protected_geography", "protected_income", "protected_loan_amount", "n", "x").count() for df in (packed, texts))
    assert a.count() > 20 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert not [c for c in packed.columns if c in VOCABULARIES]
