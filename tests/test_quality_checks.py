import oracle
import pytest
from pyspark.sql import functions as F

from riskspark import protection as P
from riskspark import queries
from riskspark.classes import equivalence_classes
from riskspark.config import TIERS
from riskspark.lar import TABLES, VOCABULARIES, applications, coded, lar, load
from test_mechanisms import plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The tables with a thirteenth of every field but the keys null, lines without an order, a race and ethnicity with few
    records, and dates at the ends of years and far from them."""
    d = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        own = [c for c in df.columns if c in ("l_orderkey", "l_linenumber", "o_orderkey", "p_partkey", "n_nationkey", "c_custkey")]
        rare = lambda c: F.pmod(F.xxhash64(F.lit(c), *own), F.lit(13)) == 0
        df = df.select(*[c if c in own else F.when(~rare(c), F.col(c)).alias(c) for c in df.columns])  # noqa: B023
        if t == "lineitem":
            ends = F.array(*[F.lit(x).cast(df.schema["l_shipdate"].dataType) for x in ("1995-12-31 23:59:59.999999", "1996-01-01", "2003-12-31 23:59:59.999999", "2004-01-01", "1970-01-01", "2100-06-01")])
            df = df.withColumns({"l_shipdate": F.when(F.col("l_orderkey") % 3 == 0, ends[F.pmod(F.hash("l_partkey", "l_suppkey"), F.lit(6))]).otherwise(F.col("l_shipdate")), "l_orderkey": F.when(F.col("l_orderkey") % 17 == 0, -1).otherwise(F.col("l_orderkey")),
                                 "l_returnflag": F.when((F.col("l_orderkey") % 20 >= 18) & (F.col("l_orderkey") % 200 != 19), "N").otherwise(F.col("l_returnflag"))})
        df.write.parquet(f"{d}/{t}.parquet")
    return d


def same(one, other):
    assert one.count() > 3 and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_checks_read_small_tables_of_classes_made_once(spark, monkeypatch):
    kept, dropped, one, gone = {}, [], queries.written, queries.discard
    monkeypatch.setattr(queries, "written", lambda df, name: kept.setdefault(name, one(df, name)) if name in ("records", "classes") else one(df, name))
    monkeypatch.setattr(queries, "discard", lambda df: dropped.append(df.columns) or gone(df))
    found = plan(queries.QUERIES["quality_checks"](spark, SF))
    assert not [c for c in ("l_orderkey", "loan_amount", "census_tract", "applicant_age") if c in found]  # neither applications nor their classes are joined, dealt or summed by a check
    assert list(kept) == ["records", "classes"] and not set(VOCABULARIES) & {c for df in kept.values() for c in df.columns}
    assert dropped == [df.columns for df in kept.values()]


@pytest.mark.parametrize("large", [False, True])
def test_checks_on_odd_inputs(spark, odd, monkeypatch, large):
    if large:  # more tasks, parts joined by sorting
        monkeypatch.setattr("riskspark.lar.JOIN_ROWS", 100)
        monkeypatch.setattr("riskspark.lar.PART_ROWS", 10)
    monkeypatch.setattr(oracle, "TABLES", TABLES)
    found = oracle.actual(queries.QUERIES["quality_checks"](spark, odd))
    assert found == oracle.expected(queries.ORACLE_SQL["quality_checks"], odd)
    planted = {r[0]: r[1] for r in found[1]}
    assert len(planted) == 9 and all(int(v) > 0 for v in planted.values())  # every kind of fault is found


def test_census_has_the_records_of_every_year(spark, odd):
    packed = coded(spark, odd, census=True)
    fields = ["census_tract", "activity_year", F.col("tract_population").cast("int").alias("tract_population"), "derived_race", "lei"]
    same(packed.unpacked(packed.rows).select(*fields), lar(spark, odd).withColumn("activity_year", F.col("activity_year").cast("int")).select(*fields))
    rest = ["census_tract", "income", "loan_amount", "action_taken", "activity_year", "is_denied", *VOCABULARIES]
    same(applications(packed.unpacked(packed.rows)).select(*rest), load(spark, odd).select(*rest))


def test_coarser_classes_of_numbers_are_those_of_texts(spark, odd):
    packed = coded(spark, odd)
    classes = P.coded_classes(packed)
    for fields in TIERS.values():
        for deal in (False, True):
            same(packed.coarser(classes.rows, fields, deal), equivalence_classes(load(spark, odd), fields))


def test_codes_of_the_modeling_cohort_from_sums(spark, odd):
    sizes = P.cohort_sizes(P.coded_classes(coded(spark, odd)))
    codes = ["configuration", "is_black", "is_denied"]
    same(P.modeling_cells(sizes).select(*codes, "n"), P.modeling_cells(load(spark, odd)).groupBy(*codes).agg(F.sum("n").alias("n")).select(*codes, "n"))
    assert sorted(map(tuple, P.protection_cells(sizes).collect())) == sorted(map(tuple, P.protection_cells(load(spark, odd)).collect()))
