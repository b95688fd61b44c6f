"""Bronze layout and manifests, mart output and the release bundle."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.config import MIN_CELL
from riskspark.governance import finite, redact
from riskspark.shared import fresh_path


def slug(text: str) -> str:
    """Lower case, with each run of anything but a-z and 0-9 as one hyphen, none at the ends."""
    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-")


def write_bronze(raw: DataFrame, root: str, scope: str, year: str = "activity_year") -> str:
    """CSV under scope=<slug>/year=YYYY; a slice never overwrites another scope, and a written scope never changes."""
    path = f"{root}/scope={slug(scope)}"
    raw.withColumn("year", F.col(year)).write.mode("errorifexists").partitionBy("year").option("header", True).csv(path)
    return path


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, retrieved_at) of every data file below path, of any size.

    Files are read as byte strings between line feeds, by as many tasks as they have splits, which join neighbouring lines, and each file's pieces
    stream in order through a digest in one task, sorted and spilled by Spark; a task holds one batch of pieces at a time. A file that ends with a line feed has one
    byte more than its pieces. Spark's readers pass over empty files, which have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("retrieved_at"))  # contents aren't read
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("piece"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's lines of one split as one numbered piece: few rows are dealt, and the path goes along once a piece."""
        i = 0
        for b in batches:
            path, at = b.column("path"), b.column("at")
            if not len(b):
                continue
            new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(at[1:], at[:-1]))
            starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1)]
            pieces = pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(b)], pa.int32()), b.column("piece")), b"\n")
            yield pa.RecordBatch.from_arrays([*b.select(["path", "size", "at"]).take(pa.array(starts)).columns, pa.array(range(i, i + len(starts)), pa.int64()), pieces], ["path", "size", "at", "i", "piece"])
            i += len(starts)

    pieces = lines.mapInArrow(joined, "path string, size long, at long, i long, piece binary")
    pieces = pieces.repartition("path").sortWithinPartitions("path", "at", "i").select("path", "size", "piece")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, seen, sha = None, 0, 0, None

        def ended() -> pa.RecordBatch:
            if seen < size:
                sha.update(b"\n")
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["path", "sha256"])

        for b in batches:
            for p, n, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != name:
                    if name is not None:
                        yield ended()
                    name, size, seen, sha = p, n, 0, hashlib.sha256()
                else:
                    sha.update(b"\n")
                    seen += 1
                sha.update(piece)
                seen += len(piece)
        if name is not None:
            yield ended()

    found = pieces.mapInArrow(digested, "path string, sha256 string")
    return files.join(found.withColumnRenamed("path", "p"), F.col("path") == F.col("p"), "left").select("path", "sha256", "bytes", "retrieved_at")


def manifest(spark: SparkSession, path: str, parameters: dict[str, str]) -> DataFrame:
    """Digest and size of every file, with the request's parameters."""
    pairs = [x for k, v in sorted(parameters.items()) for x in (F.lit(k), F.lit(v))]
    return file_digests(spark, path).withColumn("parameters", F.create_map(*pairs))


def bronze_columns(spark: SparkSession, path: str, year: int) -> list[str]:
    """The header of a year's files; looks at the first line alone."""
    return spark.read.option("header", True).csv(f"{path}/year={year}").columns


def read_bronze(spark: SparkSession, path: str, years: Sequence[int], expected: Sequence[str], optional: Sequence[str] = (), year: str = "activity_year") -> DataFrame:
    """Some years of the bronze layout by column name, whatever each year's order of columns, reading only their partitions.

    A year may lack optional columns (null there) and hold columns that aren't expected (left out); one that lacks another column is an error that names
    it. Every year's files are read with that year's own header.
    """
    headers = {y: bronze_columns(spark, path, y) for y in years}
    if lacking := {y: m for y, h in headers.items() if (m := [c for c in expected if c not in h and c not in optional])}:
        raise ValueError(f"columns missing by year: {lacking}")
    alike: dict[tuple, list[int]] = {}
    for y, h in headers.items():
        alike.setdefault(tuple(h), []).append(y)
    parts = []
    for header, of in alike.items():
        rows = spark.read.schema(", ".join([*(f"`{c}` string" for c in header), "year int"])).option("header", True).option("enforceSchema", False).csv(path).where(F.col("year").isin(of))
        parts.append(rows.select(*[(F.col(f"`{c}`") if c in header else F.lit(None).cast("string")).alias(c) for c in expected]))
    return reduce(DataFrame.unionByName, parts)


#: Records of a bucket, on average.
BUCKET_ROWS = 500_000


def buckets_for(rows: int, least: int = 16) -> int:
    """Buckets for a table of so many rows: a bucket is read by one task, so their number grows with the table."""
    return max(least, -(-rows // BUCKET_ROWS))


def bucketed(df: DataFrame, fields: Sequence[str], buckets: int, name: str) -> DataFrame:
    """df as a table in the shared folder whose files are buckets of the fields, a file each: groupings and windows by these fields, or by more, need no
    exchange. Rows alike in the fields share a bucket, so take fields without one that many rows hold alone."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *fields).write.option("path", fresh_path(spark, table)).bucketBy(buckets, *fields).saveAsTable(table)
    return spark.table(table)


def write_mart(df: DataFrame, path: str, order: list, minimum: int = MIN_CELL) -> DataFrame:
    """A small ordered mart as one JSON file, non-finite numbers as null and rows with small cells redacted; returns it as read back."""
    ready = redact(finite(df.orderBy(*order)), minimum)
    ready.coalesce(1).write.option("ignoreNullFields", False).json(path)
    return df.sparkSession.read.schema(ready.schema).json(path)


def materialize_mart(df: DataFrame, path: str) -> DataFrame:
    """A mart as a Parquet table; a written one never changes."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_context(context: DataFrame, conflicts: DataFrame, path: str, parameters: dict[str, str]) -> DataFrame:
    """Tract context as CSV files with headers, sorted by tract over all of them, and its manifest of one row: rows and tracts with conflicting populations."""
    context.orderBy("census_tract").write.mode("errorifexists").option("header", True).csv(path)
    pairs = [x for k, v in sorted(parameters.items()) for x in (F.lit(k), F.lit(v))]
    rows = context.sparkSession.read.option("header", True).csv(path).agg(F.count("*").alias("records"))
    return rows.crossJoin(conflicts.select("conflicting_tracts")).withColumn("parameters", F.create_map(*pairs))  # one row each


def _canonical(df: DataFrame, c: str) -> Column:
    """A value as text that doesn't hang on an engine's number format: doubles in whole billionths."""
    v = F.col(c)
    text = F.round(v * F.lit(1e9)).cast("decimal(38,0)").cast("string") if dict(df.dtypes)[c] == "double" else v.cast("string")
    return F.concat(F.lit(f"{c}="), F.coalesce(text, F.lit("null")))


def bundle(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(section, key, sha256) of aggregate rows, and a row with an empty key for each section whose digest is that of its rows in order of their keys.

    key: key columns joined by |, nulls left out; a row's digest covers name=value of its columns in order of name.
    """
    out = None
    for name, (df, keys) in parts.items():
        body = F.concat_ws(";", *[_canonical(df, c) for c in sorted(df.columns)])
        rows = df.select(F.lit(name).alias("section"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), F.sha2(body, 256).alias("sha256"))
        whole = rows.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("key", "sha256"))).alias("all"))  # rows of a published mart
        whole = whole.select("section", F.lit("").alias("key"), F.sha2(F.array_join(F.transform("all", lambda x: x["sha256"]), ","), 256).alias("sha256"))
        both = rows.union(whole)
        out = both if out is None else out.unionByName(both)
    return out
