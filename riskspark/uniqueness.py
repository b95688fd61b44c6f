"""How much uniqueness in a release says about the population: repeated subsampling and a gamma-Poisson fit."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.classes import equivalence_classes
from riskspark.shared import SEED, key_seed, written

#: Classes of a leaf of the draw tree, on average; leaves that one task draws, on average.
LEAF, TASK_LEAVES = 4096, 16


def _tree(classes: DataFrame, depth: int) -> DataFrame:
    """(leaf, path, sizes): each leaf's path of (records of the node, of its left child) from the root down, and its histogram of class sizes."""
    sizes = classes.groupBy("leaf", "k").agg(F.count("*").alias("classes"))
    leaves = sizes.groupBy("leaf").agg(F.sum(F.col("k") * F.col("classes")).alias("n"), F.array_sort(F.collect_list(F.struct("k", "classes"))).alias("sizes"))
    if not depth:
        return leaves.select("leaf", F.array().cast("array<struct<l:int,left:boolean,n:bigint,first:bigint>>").alias("path"), "sizes")
    # of each node at each level the records of its first half
    up = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("l"), "leaf", "n").withColumn("node", F.expr(f"shiftright(leaf, {depth} - l)"))
    left = F.expr(f"shiftright(leaf, {depth} - l - 1) % 2 = 0")
    nodes = up.groupBy("l", "node").agg(F.sum("n").alias("n"), F.sum(F.when(left, F.col("n")).otherwise(0)).alias("first"))
    of = up.select("leaf", "l", "node", left.alias("left")).join(nodes, ["l", "node"])
    paths = of.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("l", "left", "n", "first"))).alias("path"))  # depth entries
    return paths.join(leaves.select("leaf", "sizes"), "leaf")


def subsample_uniqueness(df: DataFrame, fields: Sequence[str], fraction: float, replicates: int = 200, seed: int = SEED, leaf: int = LEAF) -> DataFrame:
    """Share of classes unique in a draw that are unique in the whole, over repeated draws of a fixed size without replacement.

    A draw is split down a binary tree over hashes of the classes, which deepens as they grow in number: at a node the part of its left half is
    hypergeometric, drawn with a generator of (seed, level, node) for all replicates, so every leaf below finds the same numbers by itself,
    from the sizes along its path. A leaf of about `leaf` classes splits its part over its histogram of sizes; of unique classes the
    number drawn is what counts, larger ones are drawn one by one. Nothing hangs on partitions, and no leaf grows with the records.

    One row: records unique in the release, how many of them that share makes unique in the population, mean, standard deviation, quantiles.
    """
    if not 0 < fraction < 1 or replicates < 30:
        raise ValueError("a fraction strictly between 0 and 1 and at least 30 replicates are needed")
    classes = written(equivalence_classes(df, fields).select("k", F.xxhash64(*fields).alias("h")), "class-sizes")
    count, total, unique = classes.agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0)), F.count_if(F.col("k") == 1)).first()
    if total < 2:
        raise ValueError("at least two records are needed")
    depth = max(0, math.ceil(math.log2(max(count, 1) / leaf)))
    draw = max(1, round(total * fraction))
    tree = _tree(classes.select("k", F.expr(f"shiftrightunsigned(h, {64 - depth})" if depth else "0L").alias("leaf")), depth)

    def drawn(pdfs):
        for pdf in pdfs:
            for node, path, sizes in zip(pdf["leaf"], pdf["path"], pdf["sizes"], strict=True):
                need = np.full(replicates, draw)
                for level, left, n, first in ((s["l"], s["left"], s["n"], s["first"]) for s in path):
                    rng = np.random.default_rng(key_seed(seed, level, node >> (depth - level)))
                    got = rng.hypergeometric(first, n - first, need)
                    need = got if left else need - got
                rng = np.random.default_rng(key_seed(seed, "leaf", node))
                rest = sum(s["k"] * s["classes"] for s in sizes)
                single, also = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
                for k, n in ((s["k"], s["classes"]) for s in sizes):
                    got = rng.hypergeometric(k * n, rest - k * n, need)
                    need, rest = need - got, rest - k * n
                    if k == 1:
                        also = got
                        single += got
                    else:
                        each = np.full(n, k)
                        single += [int((rng.multivariate_hypergeometric(each, int(x), method="marginals") == 1).sum()) if x else 0 for x in got]
                yield pd.DataFrame({"replicate": np.arange(replicates, dtype=np.int32), "draw_unique": single, "also_unique": also})

    # a leaf's row is small but its draws are not, so tasks are counted by leaves: by bytes Spark would put them all into one
    tree = tree.repartition(max(1, 2**depth // TASK_LEAVES), "leaf")
    per = tree.mapInPandas(drawn, "replicate int, draw_unique long, also_unique long")
    s = per.groupBy("replicate").agg(F.sum("draw_unique").alias("d"), F.sum("also_unique").alias("a")).where("d > 0").select((F.col("a") / F.col("d")).alias("s"))
    out = s.agg(F.count("*").alias("usable_replicates"), F.round(F.mean("s"), 9).alias("mean_share"), F.round(F.stddev_samp("s"), 9).alias("sd_share"), F.round(F.percentile("s", F.lit(0.025)), 9).alias("share_low"), F.round(F.percentile("s", F.lit(0.975)), 9).alias("share_high"))
    return out.select(
        F.lit("repeated_subsampling_proxy").alias("method"), F.lit(float(fraction)).alias("sample_fraction"), F.lit(unique).cast("long").alias("sample_unique_records"), F.round(F.lit(unique) * F.col("mean_share"), 6).alias("estimated_population_unique_records"),
        "*", F.lit(seed).alias("random_seed"), F.when(F.col("usable_replicates") < 30, "too_few_usable_replicates").otherwise("estimated").alias("status"),
    )


def log_gamma(x: Column) -> Column:
    """ln Gamma of a positive number: Stirling's series at x + 8, less the logarithm of the product that the shift adds."""
    y = x + F.lit(8.0)
    z = F.lit(1.0) / (y * y)
    series = F.lit(1 / 156) * z - F.lit(691 / 360360)
    for c in (1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12):
        series = series * z + F.lit(c)
    shift = (x + F.lit(7.0)).cast("double")
    for i in range(7):
        shift = shift * (x + F.lit(float(i)))
    # beyond 1e6 the product may leave the doubles' range after powers, so its logarithm is taken in two halves
    far = x > 1e6
    halves = [F.lit(1.0), F.lit(1.0)]
    for i in range(8):
        halves[i % 2] = halves[i % 2] * (x + F.lit(float(i)))
    product = F.when(far, F.log(halves[0]) + F.log(halves[1])).otherwise(F.log(shift))
    return (y - F.lit(0.5)) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series / y - product


# Where the search begins, and what a fit at the edge is.
SHAPES, RATES = tuple(np.linspace(math.log(0.03), math.log(30), 28)), tuple(np.linspace(math.log(0.01), math.log(100), 32))
SMALLEST_SHAPE, SMALLEST_RATE, LARGEST_RATE = 1e-4, 1e-5, 1e5
ASSUMPTION = "scenario_only_coverage_fraction_not_identified"


def shape_sums(histogram: DataFrame, shapes: Sequence[float]) -> DataFrame:
    """(shape, classes, records, ways): of the histogram (k, classes), summed, what the likelihood needs; ways is the only sum that hangs on the shape."""
    rows = histogram.select("k", "classes", F.explode(F.array(*[F.lit(float(s)) for s in shapes])).alias("shape"))
    k = F.col("k").cast("double")
    ways = F.col("classes") * (log_gamma(k + F.col("shape")) - log_gamma(F.col("shape")) - log_gamma(k + 1))
    return rows.groupBy("shape").agg(F.sum("classes").alias("classes"), F.sum(F.col("k") * F.col("classes")).alias("records"), F.sum(ways).alias("ways"))


def _likelihood(q: Column, shape: Column) -> Column:
    """Log-likelihood of class sizes that are negative binomial and never 0, of shape and the chance q = coverage / (rate + coverage)."""
    none = F.log1p(-q) * shape  # ln of the chance of an empty class
    return F.col("ways") + F.col("classes") * none + F.col("records") * F.log(q) - F.col("classes") * F.log(-F.expm1(none))


def likelihood_grid(histogram: DataFrame, coverages: Sequence[float] = (0.1, 0.25, 0.5)) -> DataFrame:
    """(coverage, i, j, log_likelihood) over the fixed grid of shapes and rates, one pass over the histogram."""
    spots = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.lit(j).alias("j"), F.lit(c / (math.exp(r) + c)).alias("q")) for c in coverages for j, r in enumerate(RATES)]))
    sums = shape_sums(histogram, [math.exp(s) for s in SHAPES])
    number = F.array_position(F.array(*[F.lit(float(math.exp(s))) for s in SHAPES]), F.col("shape")) - 1
    return sums.withColumn("at", spots).select(F.col("at.coverage").alias("coverage"), number.cast("int").alias("i"), F.col("at.j").alias("j"), _likelihood(F.col("at.q"), F.col("shape")).alias("log_likelihood"))


def _best_chance(shapes: Sequence[float], mean: float) -> list[float]:
    """For each shape the chance q at which the truncated mean is the observed one, where the likelihood is greatest: the mean grows with q."""
    out = []
    for s in shapes:
        low, high = -700.0, 40.0  # the log odds of q
        for _ in range(200):
            mid = (low + high) / 2
            filled = -math.expm1(-s * np.logaddexp(0.0, mid))  # 1 - (1 - q) ** s, with ln(1 - q) = -ln(1 + e^mid)
            low, high = (low, mid) if s * math.exp(mid) / max(filled, 1e-300) > mean else (mid, high)
        out.append(low)
    return out


def gamma_poisson(distribution: DataFrame, coverages: Sequence[float] = (0.1, 0.25, 0.5), points: int = 33, rounds: int = 12) -> DataFrame:
    """Zero-truncated gamma-Poisson fits for each coverage to the histogram (k, classes), whose rows grow with the square root of the records.

    Only q = coverage / (rate + coverage) and the shape enter the likelihood, so one search serves all coverages. For a given shape the best q is where
    the truncated mean equals the observed one. So each round is a Spark job that sums the histogram for `points` shapes of a bracket, and the
    next bracket lies around the best; it moves outward first while the best is at an end. A likelihood that rises without end towards
    a limit gives `boundary_fit_not_reportable`. A row for each coverage.
    """
    if not all(0 < c < 1 for c in coverages):
        raise ValueError("coverage must lie strictly between 0 and 1")
    histogram = written(distribution.select("k", "classes"), "class-histogram")
    total, least, ones = histogram.agg(F.coalesce(F.sum("classes"), F.lit(0)), F.min("k"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("classes"))), F.lit(0))).first()
    if total < 2 or least < 1:
        raise ValueError("two or more classes of positive size are needed")

    def score(at: Sequence[float]) -> list[tuple[float, float, float]]:
        """(log-likelihood, log shape, log odds of q) of the best q for each log shape."""
        exact = [math.exp(a) for a in at]
        sums = {r["shape"]: r for r in shape_sums(histogram, exact).collect()}  # `points` rows
        first = next(iter(sums.values()))
        found = []
        for a, s, odds in zip(at, exact, _best_chance(exact, float(first["records"]) / float(first["classes"])), strict=True):
            filled, r = -s * np.logaddexp(0.0, odds), sums[s]
            value = r["ways"] + r["classes"] * filled - r["records"] * np.logaddexp(0.0, -odds) - r["classes"] * math.log(-math.expm1(filled)) if filled < 0 and -math.expm1(filled) > 1e-14 else -math.inf
            found.append((float(value), a, odds))
        return found

    low, high = SHAPES[0], SHAPES[-1]
    for _ in range(rounds):
        got = score(np.linspace(low, high, points))
        best = max(got)
        step = (high - low) / (points - 1)
        if best[1] <= low + step / 2 and low > math.log(SMALLEST_SHAPE) - 4:
            low, high = low - (high - low), low + step
        elif best[1] >= high - step / 2 and high < 40:
            low, high = high - step, high + (high - low)
        else:
            low, high = best[1] - step, best[1] + step
        if high - low < 1e-9:
            break
    value, log_shape, odds = best
    shape, rows = math.exp(log_shape), []
    for c in coverages:
        rate = c * math.exp(-odds) if odds > -700 else math.inf
        edge = shape < SMALLEST_SHAPE or not SMALLEST_RATE <= rate <= LARGEST_RATE
        p = None if edge else math.exp((shape + 1) * math.log((rate + c) / (rate + 1)))
        rows.append(("zero_truncated_gamma_poisson", c, int(total), int(ones), shape, rate, p, None if p is None else ones * p, value, "boundary_fit_not_reportable" if edge else "estimated", ASSUMPTION))
    return distribution.sparkSession.createDataFrame(rows, "method string, coverage_fraction double, observed_equivalence_classes long, sample_unique_records long, gamma_shape double, gamma_rate double, population_unique_probability double, estimated_population_unique_records double, log_likelihood double, fit_status string, assumption_status string")
