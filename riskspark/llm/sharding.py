"""Balanced contiguous shards by a global prefix sum of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import discard, in_buckets, materialize

ROW_OVERHEAD = 16


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """size: UTF-8 bytes of the text (null: none) plus a fixed overhead; text_crc32 of the text (null: of no bytes)."""
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    return docs.withColumns({"size": F.octet_length(body).cast("long") + ROW_OVERHEAD, "text_crc32": F.crc32(body)})


def assign_shards(docs: DataFrame, shards: int = 40, order: tuple[str, ...] = ("doc_id",), size: str = "size", partitions: int | None = None) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 within the shard).

    Rows are range-partitioned in the given order; each partition sums its bytes, a prefix sum over these few totals
    gives each partition its offset, and a running sum inside the partition gives each row its global byte position. The
    ranges are written as the buckets of a table, so rows are dealt once.
    A row goes to the shard that holds the middle of its byte range, so the cuts lie at equal byte targets, shards
    are contiguous in the order and differ from the mean by one row's size at most.

    Nulls in the order columns come first. Tied and repeated rows are told apart by a row number fixed when the sizes
    are written, so one key with a third of all rows is cut like any other run. An empty input gives an empty result.
    All columns of the input are kept, whatever the length of their values, but columns called shard, slot or starting with `_ps_` are replaced.
    """
    docs = docs.drop("shard", "slot")
    keys = [*order, "_ps_row"]
    numbered = materialize(docs.withColumn("_ps_row", F.monotonically_increasing_id()), "shard-rows")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = numbered.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys]).withColumn("_ps_part", F.spark_partition_id())
    # a number for each range whose hash is the range's own bucket, so a bucket holds one range and the windows below need no exchange
    tried = docs.sparkSession.range(64 * n).select(F.col("id").cast("int").alias("_ps_bucket"))
    bucket_of = tried.groupBy(F.pmod(F.hash("_ps_bucket"), F.lit(n)).alias("_ps_part")).agg(F.min("_ps_bucket").alias("_ps_bucket"))
    ranged = ranged.join(F.broadcast(bucket_of), "_ps_part", "left").withColumn("_ps_bucket", F.coalesce("_ps_bucket", -1 - F.col("_ps_part")))  # a row for each range
    with in_buckets(ranged, "shard_ranges", n, "_ps_bucket") as dealt:
        placed = _placed(dealt, keys, size, shards)
    discard(numbered)
    starts = placed.groupBy("shard").agg(F.min("_ps_index").alias("_ps_start"))  # one row per shard
    out = placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_ps_index") - F.col("_ps_start"))
    return out.drop(*[c for c in out.columns if c.startswith("_ps_")])


def _placed(ranged: DataFrame, keys: list[str], size: str, shards: int) -> DataFrame:
    """ranged, a bucket for each range, with shard and _ps_index, each row's number in the global order; written."""
    part = Window.orderBy("_ps_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_ps_part").agg(F.sum(size).alias("_ps_bytes"), F.count("*").alias("_ps_rows"))
    offsets = totals.select(  # one row per partition: the window over it is as small as the partition count
        "_ps_part",
        F.coalesce(F.sum("_ps_bytes").over(part), F.lit(0)).alias("_ps_before"),
        F.coalesce(F.sum("_ps_rows").over(part), F.lit(0)).alias("_ps_rows_before"),
        F.sum("_ps_bytes").over(Window.partitionBy()).alias("_ps_total"),
    )
    inside = Window.partitionBy("_ps_bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("_ps_before") + F.sum(size).over(inside)) - F.col(size)
    placed = (
        ranged.join(F.broadcast(offsets), "_ps_part")
        .withColumn("_ps_middle", middle)
        .withColumn("_ps_index", F.col("_ps_rows_before") + F.count("*").over(inside) - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(_ps_middle * {shards}L) div greatest(2L * _ps_total, 1L)")).cast("int"))
    )
    return materialize(placed, "shard-places")
