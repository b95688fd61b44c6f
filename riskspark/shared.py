"""Folders that all executors share, and small tables sent to all of them."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 20260823


def key_seed(seed: int, *keys: object) -> int:
    """A generator's seed from a seed and keys, alike in every process."""
    return int.from_bytes(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).digest()[:8], "little")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where that is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def broadcast_within(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Mark a frame for broadcast if it counts max_rows rows at most; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= max_rows else df


def small_table(df: DataFrame, name: str) -> DataFrame:
    """A table that is small by its nature (tracts, keys): written once, counted, and marked for broadcast within the bound."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return broadcast_within(df.sparkSession.read.schema(df.schema).parquet(path))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what reads it many times: lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a written table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)
