"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What a task gets of a frame sent to all of them at most.
MAX_BROADCAST_BYTES = 1 << 25
_OWN_DIR: list[str] = []
#: Folders written inside the open scratch blocks, innermost last.
_FOLDERS: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-"))
    return _OWN_DIR[0]


def _fresh(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _FOLDERS and not keep:
        _FOLDERS[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here and survives lost executors.

    The folder stays until it is discarded or, unless keep is set, the scratch block around ends.
    """
    spark = df.sparkSession
    path = _fresh(spark, name, keep)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder)).toString())


@contextmanager
def in_buckets(df: DataFrame, name: str, buckets: int, column: str) -> Iterator[DataFrame]:
    """The frame as a table in hash buckets of a column, dropped at the block's end: groupings and windows by the column need no exchange."""
    spark, table_name, path = df.sparkSession, f"{name}_{uuid.uuid4().hex}", _fresh(df.sparkSession, name)
    df.write.option("path", path).bucketBy(buckets, column).saveAsTable(table_name)
    try:
        yield spark.table(table_name)
    finally:
        spark.sql(f"drop table {table_name}")
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators materialize inside this block is deleted at its end, also after an error: write the results with keep set, or elsewhere, before."""
    own: list[str] = []
    _FOLDERS.append(own)
    try:
        yield
    finally:
        del _FOLDERS[next(i for i, x in enumerate(_FOLDERS) if x is own)]
        for folder in own:
            _delete(spark, folder)


def broadcast_within(df: DataFrame, row_bytes: Column | int = 64, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark a frame for broadcast if its rows, of row_bytes each (a number or a column), stay within max_bytes; beyond that Spark
    shuffles both sides and hashes this one."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df.hint("shuffle_hash")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other letters as they are; pure ASCII texts take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_hash(text: Column) -> Column:
    """With doc_id, the key that ties results to rows: rows alike in both are alike in every result."""
    return F.xxhash64(text)
