"""Centroid clustering over a VA-file: vectors as few-bit cells, distance intervals from lookup tables, whole vectors only where intervals overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import discard, materialize

CELLS = 256  # of each dimension: a byte where the vector has four
#: Components beyond this would carry squared distances of 64 dimensions out of 64-bit integers.
LIMIT = 1 << 27
NONE, OPEN = -2, -1


@dataclass
class Clustering:
    rows: DataFrame  # vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256
    centroids: list[list[int]]
    fetched: list[int]  # whole vectors that each round, and the last assignment, looked at


def whole_components(column: Column, dims: int, scale: int) -> tuple[Column, Column]:
    """(whether a vector counts, its components as whole numbers): exactly dims components, none null or non-finite."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(column, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fits = F.forall(whole, lambda v: F.abs(v) <= LIMIT)
    counts = F.coalesce((F.size(column) == dims) & finite, F.lit(False))
    return counts, F.when(~counts, None).when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for 64-bit distances"))).cast("array<int>")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


class Approximation:
    """Cells of each dimension: edges at quantiles, outer cells ended by the least and greatest value."""

    def __init__(self, edges: np.ndarray, least: np.ndarray, greatest: np.ndarray):
        self.edges = edges.astype(np.int64)  # dims x (CELLS - 1)
        self.low = np.concatenate([least[:, None], self.edges], axis=1).astype(np.int64)
        self.high = np.concatenate([self.edges - 1, greatest[:, None]], axis=1).astype(np.int64)

    @staticmethod
    def of(vectors: DataFrame) -> Approximation | None:
        """From all vectors: one pass of quantile sketches, whose error moves edges but no result. None without vectors."""
        at = [i / CELLS for i in range(1, CELLS)]
        each = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.percentile_approx("v", at, 4 * CELLS).alias("q"), F.min("v").alias("a"), F.max("v").alias("z"))
        rows = sorted(each.collect(), key=lambda r: r["i"])  # a row for each dimension
        return Approximation(*(np.array([r[c] for r in rows]) for c in "qaz")) if rows else None

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, side="right") for e, v in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest part of the squared distance that a dimension's cell adds, for each centroid: dims x CELLS x centroids.

        The squared distance to the centroids' middle is taken off all of them alike. What is left is linear inside a cell, so the intervals
        are as much narrower as centroids lie nearer to their middle than vectors do.
        """
        m, middle = centroids.T[:, None, :], (centroids.sum(axis=0) // len(centroids))[:, None, None]
        ends = [(x[:, :, None] - m) ** 2 - (x[:, :, None] - middle) ** 2 for x in (self.low, self.high)]
        return np.minimum(*ends), np.maximum(*ends)


class Assigner:
    """Nearest centroids. Of equal centroids only the first can win."""

    def __init__(self, approximation: Approximation, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        self.live = np.array(sorted({tuple(c): i for i, c in reversed(list(enumerate(centroids)))}.values()))
        self.least, self.most = approximation.tables(self.centroids[self.live])

    def by_cells(self, codes: np.ndarray) -> np.ndarray:
        """Of each code the centroid whose interval lies below all others; OPEN where intervals overlap."""
        least = np.zeros((len(codes), len(self.live)), np.int64)
        most = np.zeros_like(least)
        for j in range(codes.shape[1]):
            least += self.least[j].take(codes[:, j], axis=0)
            most += self.most[j].take(codes[:, j], axis=0)
        can = least <= most.min(axis=1, keepdims=True)
        return np.where(can.sum(axis=1) == 1, self.live[can.argmax(axis=1)], OPEN)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of whole vectors, ties to the smaller number."""
        d = np.stack([((x - self.centroids[c]) ** 2).sum(axis=1) for c in self.live], axis=1)
        return self.live[d.argmin(axis=1)]


def _by_cells(before: Assigner | None, now: Assigner):
    """A column function of the code: (before, now), centroids under two sets of them."""

    @F.pandas_udf("before int, now int")
    def assigned(code: pd.Series) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
        return pd.DataFrame({"before": before.by_cells(codes) if before else NONE, "now": now.by_cells(codes)}, index=code.index, dtype=np.int32)

    return assigned.asNondeterministic()  # computed once, not again in the filter


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", embedding: str = "embedding") -> Clustering:
    """Lloyd's rounds on whole numbers floor(scale * component), exact to the last digit.

    Vectors with another length or with null or non-finite components are left out; a component beyond LIMIT is an error. Centroids start as
    the vectors with the smallest sha256 of seed:key (of repeated keys the smaller vector; a null key has no digits); there are fewer if
    fewer vectors count. Repeated rows are vectors of their own. Other columns play no part. An empty table gives an empty result.

    The VA-file holds a code of eight bits a dimension beside each vector. A round looks codes up in the interval tables of the present and of
    the previous centroids, and takes whole vectors where an interval overlaps another or where the centroid changed: a cluster's sums move by
    these alone, so nothing is carried between rounds but the sums. Tasks add up what moved, by cluster; no vector leaves its task.
    """
    spark = vectors.sparkSession
    counts, whole = whole_components(F.col("e"), dims, scale)
    kept = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("e")).where(counts).select("vec_id", whole.alias("x"))
    empty = spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not (va := Approximation.of(kept)):
        return Clustering(empty, [], [])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = va.encode(_matrix(b.column(1), dims))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary())], ["vec_id", "x", "code"])

    file = materialize(kept.mapInArrow(coded, "vec_id long, x array<int>, code binary"), "va-file")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = [list(r["x"]) for r in file.select(order.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()]
    n, sums, fetched = [0] * len(centroids), [[0] * dims for _ in centroids], []
    before = None

    def moved(earlier: Assigner | None, now: Assigner):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, total, looked = np.zeros(len(now.centroids), np.int64), np.zeros((len(now.centroids), dims), np.int64), 0
            for b in batches:
                x, was, is_ = _matrix(b.column(0), dims), b.column(1).to_numpy().copy(), b.column(2).to_numpy().copy()
                looked += len(x)
                if (o := is_ == OPEN).any():
                    is_[o] = now.exact(x[o])
                if earlier and (o := was == OPEN).any():
                    was[o] = earlier.exact(x[o])
                for side, sign in ((is_, 1), (was, -1)):
                    for c in np.unique(side[(was != is_) & (side != NONE)]):
                        of = (side == c) & (was != is_)
                        size[c] += sign * of.sum()
                        total[c] += sign * x[of].sum(axis=0)
            changed = [int(c) for c in np.flatnonzero(size | (total != 0).any(axis=1))]
            rows = [(c, int(size[c]), total[c].tolist()) for c in changed] + [(-1, looked, [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["c", "n", "s"])

        return run

    for _ in range(rounds):
        now = Assigner(va, centroids)
        seen = file.select("x", _by_cells(before, now)("code").alias("a")).select("x", "a.before", "a.now").where("before <> now or now < 0")
        part = seen.mapInArrow(moved(before, now), "c int, n long, s array<long>")
        part = part.select("c", F.posexplode(F.concat(F.array("n"), "s")).alias("i", "v")).groupBy("c", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        looked = 0
        for c, i, v in part.collect():  # a row for each centroid and dimension at most
            if c < 0:
                looked = int(v)
            elif i:
                sums[c][i - 1] += int(v)
            else:
                n[c] += int(v)
        fetched.append(looked)
        before, centroids = now, [[s // n[c] for s in sums[c]] if n[c] else centroids[c] for c in range(len(centroids))]

    last = Assigner(va, centroids)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, c = _matrix(b.column(1), dims), b.column(2).to_numpy().copy()
            open_ = c == OPEN
            c[open_] = last.exact(x[open_]) if open_.any() else 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.int32()), pa.array(((x - last.centroids[c]) ** 2).sum(axis=1)), pa.array(open_)], ["vec_id", "cluster", "distance", "open"])

    own = file.select("vec_id", "x", _by_cells(None, last)("code").alias("a")).select("vec_id", "x", "a.now")
    rows = materialize(own.mapInArrow(measured, "vec_id long, cluster int, distance long, open boolean"), "clusters")
    discard(file)
    inertia = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if("open").alias("o")).collect()}  # a row for each cluster
    fetched.append(sum(r["o"] for r in inertia.values()))
    every = int(sum(r["s"] for r in inertia.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, int(r["s"]), every, sha[c]) for c, r in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.drop("open").join(F.broadcast(facts), "cluster")  # a row for each cluster
    return Clustering(out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids, fetched)
