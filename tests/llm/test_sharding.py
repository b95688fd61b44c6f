"""Shards dealt by one exchange, places as a running sum in order gives them, and folders given back."""

import os

import pytest

from riskspark.llm import common, sharding


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_over_ranges_need_no_exchange(spark, monkeypatch):
    seen = []
    materialize = common.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, name: seen.append((name, plan(df))) or materialize(df, name))
    df = spark.range(5000).selectExpr("id % 700 as doc_id", "id * 7919 % 5000 + 16 as size")
    rows = sharding.assign_shards(df, shards=7, order=("doc_id", "size"), partitions=11).collect()
    placed = dict(seen)["shard-places"].replace("BroadcastExchange", "")
    assert "Window" in placed and "hashpartitioning(_ps_bucket" not in placed and "Bucketed: true" in placed
    total, before, want = sum(r["size"] for r in rows), 0, []
    for doc_id, size in sorted((r.doc_id, r["size"]) for r in rows):
        want.append((doc_id, size, min(6, (2 * before + size) * 7 // (2 * total))))
        before += size
    assert len(rows) == 5000 and sorted((r.doc_id, r["size"], r.shard) for r in rows) == want
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_one_bucket_holds_one_range(spark, monkeypatch):
    held = []
    placed = sharding._placed
    monkeypatch.setattr(sharding, "_placed", lambda ranged, *a: held.extend(ranged.selectExpr("_ps_part", "_ps_bucket", "pmod(hash(_ps_bucket), 13) as b").distinct().collect()) or placed(ranged, *a))
    sharding.assign_shards(spark.range(2000).selectExpr("id as doc_id", "1L as size"), shards=3, partitions=13)
    assert len(held) == 13 and all(r.b == r._ps_part for r in held)


def test_scratch_folders_are_given_back(spark):
    folder = common.scratch_dir(spark).removeprefix("file:")
    before, tables = set(os.listdir(folder)), len(spark.catalog.listTables())
    with common.scratch(spark):
        common.materialize(spark.range(3).toDF("x"), "gone")
        kept = common.materialize(spark.range(4).toDF("x"), "kept", keep=True)
        with common.scratch(spark):
            common.materialize(spark.range(3).toDF("x"), "inner")
    with pytest.raises(ZeroDivisionError), common.scratch(spark), common.in_buckets(spark.range(9).toDF("x"), "cut", 3, "x"):
        common.materialize(spark.range(3).toDF("x"), "failed")
        raise ZeroDivisionError
    assert {f.split("-")[0] for f in set(os.listdir(folder)) - before} == {"kept"} and kept.count() == 4
    assert len(spark.catalog.listTables()) == tables
    common.discard(kept)
    assert set(os.listdir(folder)) == before
