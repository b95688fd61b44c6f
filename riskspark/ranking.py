"""Ranks, quantile groups and exact percentiles over whole tables: range partitions, counts of each, and offsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.shared import written

IN_PARTITION = (1 << 33) - 1


def _offsets(totals: list[tuple[int, int]]) -> tuple[dict[int, int], int]:
    out, at = {}, 0
    for part, n in sorted(totals):
        out[part], at = at, at + n
    return out, at


def _with_offsets(df: DataFrame, part: Column, totals: list[tuple[int, int]]) -> tuple[DataFrame, int]:
    """df with _start, what the ranges before its row's range hold; the sum over all ranges."""
    offsets, n = _offsets(totals)
    starts = df.sparkSession.createDataFrame(sorted(offsets.items()), "_range int, _start long")
    return df.withColumn("_range", part).join(F.broadcast(starts), "_range").drop("_range"), n  # a row for each range


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank") -> tuple[DataFrame, int]:
    """(df with `name`, its row's number from 0 in the order; the number of rows), no task holding more than a range of rows.

    Rows are dealt to ranges and sorted there, and written with their number inside the range; the rank adds what the ranges before hold.
    The order should name a row uniquely, else equal rows are numbered in any order. Nulls come first. Only one count for each range reaches the driver.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = written(dealt, "ranges")
    part = F.shiftright("_id", 33).cast("int")
    placed, n = _with_offsets(dealt, part, [tuple(r) for r in dealt.groupBy(part).count().collect()])
    return placed.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit(IN_PARTITION))).drop("_id", "_start"), n


def ntile(df: DataFrame, groups: int, order: Sequence[str], name: str) -> DataFrame:
    """The SQL function over the whole table: group numbers from 1, the first groups a row larger where sizes can't be equal."""
    out, n = ranked(df, order, "_rank")
    size, larger = divmod(n, groups)
    edge = larger * (size + 1)
    late = F.expr(f"{larger} + (_rank - {edge}) div {max(size, 1)}")
    return out.withColumn(name, F.when(F.col("_rank") < edge, F.expr(f"_rank div {size + 1}")).otherwise(late).cast("long") + 1).drop("_rank")


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, at: float = 0.5, name: str = "percentile") -> DataFrame:
    """(keys, name): the percentile of each key's non-null values, between the two nearest values as SQL's percentile_cont has it.

    Values are counted by key first (a histogram, summed before the shuffle), the counts dealt to ranges of (key, value) and summed up along them, so a
    key with very many values spreads over tasks like any other. A value is looked up by its place: the sum before the key's first row
    plus the place asked for. Only one count for each range reaches the driver. Null keys are a key; infinite and NaN values keep Spark's order.
    """
    histogram = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = histogram.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v").withColumn("_part", F.spark_partition_id())
    fields = [*keys, "_v", "_n", "_part"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*fields).schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            upto = pc.add(pc.cumulative_sum(b.column("_n")), before)
            yield pa.RecordBatch.from_arrays([*b.columns, upto], [*b.schema.names, "_upto"])
            before = upto[-1].as_py() if len(upto) else before

    dealt = written(dealt.select(*fields).mapInArrow(summed, f"{kinds}, _upto long"), "values")
    dealt, _ = _with_offsets(dealt, F.col("_part"), [tuple(r) for r in dealt.groupBy("_part").agg(F.sum("_n")).collect()])
    upto = F.col("_start") + F.col("_upto")
    placed = dealt.select(*keys, "_v", (upto - F.col("_n")).alias("_from"), upto.alias("_to"))
    spans = placed.groupBy(*keys).agg(F.min("_from").alias("_first"), F.max("_to").alias("_last"))
    spot = F.lit(float(at)) * (F.col("_last") - F.col("_first") - 1)
    spans = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_first") + F.floor(spot)).alias("_low"), (F.col("_first") + F.ceil(spot)).alias("_high"), (spot - F.floor(spot)).alias("_part"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    near = placed.join(spans, on).where(((F.col("_low") >= F.col("_from")) & (F.col("_low") < F.col("_to"))) | ((F.col("_high") >= F.col("_from")) & (F.col("_high") < F.col("_to"))))
    low = F.max(F.when((F.col("_low") >= F.col("_from")) & (F.col("_low") < F.col("_to")), F.col("_v")))
    high = F.max(F.when((F.col("_high") >= F.col("_from")) & (F.col("_high") < F.col("_to")), F.col("_v")))
    ends = near.groupBy(*keys).agg(low.alias("_a"), high.alias("_b"), F.max("_part").alias("_w"))  # two rows a key at most
    return ends.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * (1 - F.col("_w")) + F.col("_b") * F.col("_w")).alias(name))
