"""Randomised and numerical jobs. Random draws hang on (seed, key), never on partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.classes import equivalence_classes, share
from riskspark.config import BLACK, DEMO_GEO, NON_HISPANIC, WHITE
from riskspark.measures import MISSING
from riskspark.shared import SEED, key_seed, small_table, written

def md5_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by |; alike in Spark and other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def text_key(fields: Sequence[str]) -> Column:
    """Fields as one text, nulls as one literal value; numbers must be whole."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in fields])


#: Records of a class that are drawn before it is known whether the others matter.
DRAWN_FIRST = 16


def subsample_md5(df: DataFrame, fields: Sequence[str], fraction: float, replicates: int = 30, seed: int = SEED) -> DataFrame:
    """(replicate, draw_unique, also_unique) when each record is drawn by itself with the given chance: md5 uniforms of the seed, the replicate,
    the class and the record's number in it, so other engines draw alike.

    Of a class only draws of exactly one record count. Where two of its first records are drawn the draw isn't unique, whatever the others say; the
    others are drawn only for the rest of the classes, so the work grows with the classes and hardly with their records."""
    classes = equivalence_classes(df, fields).select("k", F.md5(text_key(fields)).alias("class"))
    each = classes.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    hit = md5_uniform(F.lit(str(seed)), F.col("replicate").cast("string"), F.col("class"), F.col("i").cast("string")) < fraction
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("k"), F.lit(DRAWN_FIRST))))
    begun = each.withColumn("i", first).groupBy("replicate", "class").agg(F.count_if(hit).alias("n"), F.max("k").alias("k")).where("n < 2")
    others = begun.where(F.col("k") > DRAWN_FIRST).withColumn("i", F.explode(F.sequence(F.lit(DRAWN_FIRST + 1).cast("long"), "k")))
    rest = others.groupBy("replicate", "class").agg((F.max("n") + F.count_if(hit)).alias("n"), F.max("k").alias("k"))
    n = begun.where(F.col("k") <= DRAWN_FIRST).unionByName(rest).where("n = 1")
    return n.groupBy("replicate").agg(F.count("*").alias("draw_unique"), F.count_if(F.col("k") == 1).alias("also_unique"))


CELLS = 1024


def marginals(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(i, value, lo, hi): of each field (by its number) each distinct value's range among the df's records, in order of two digits of its md5
    and then of the value; values as text. One pass over the records counts all fields.

    The ranges are prefix sums: over the 256 totals of a field's digits, and over the values inside each.
    """
    number = {i: dict(df.dtypes)[f] not in ("string",) for i, f in enumerate(fields)}
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("string").alias("value"), (F.col(f).cast("double") if number[i] else F.lit(None).cast("double")).alias("number")) for i, f in enumerate(fields)])
    h = df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("i", "value", "number").agg(F.count("*").alias("c")).withColumn("part", F.substring(F.md5(F.coalesce("value", F.lit(MISSING))), 1, 2))
    inside = F.sum("c").over(Window.partitionBy("i", "part").orderBy(F.col("number").asc_nulls_first(), F.col("value").asc_nulls_first()))
    h = written(h.withColumn("inside", inside), "marginals")
    parts = h.groupBy("i", "part").agg(F.sum("c").alias("all"))  # 256 rows a field
    before = F.coalesce(F.sum("all").over(Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.join(F.broadcast(parts.select("i", "part", before.alias("before"))), ["i", "part"])
    return h.select("i", "value", (F.col("before") + F.col("inside") - F.col("c")).alias("lo"), (F.col("before") + F.col("inside")).alias("hi"))


def synthetic_auxiliary(df: DataFrame, fields: Sequence[str], n: int, seed: int = SEED) -> DataFrame:
    """n records whose fields are drawn independently from their marginals (nulls are values): prefix sums on Spark,
    md5 uniforms, and one equi-join of all fields' drawn positions with the ranges' cells. Numbers must be whole."""
    total = df.count()
    step = max(1, -(-total // CELLS))
    cells = marginals(df, fields).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))))
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(fields)]))
    drawn = df.sparkSession.range(n).select(F.col("id").alias("record"), spots.alias("s")).select("record", "s.*")
    drawn = drawn.withColumn("at", F.floor(md5_uniform(F.lit(str(seed)), F.col("f"), F.col("record").cast("string")) * F.lit(total))).withColumn("cell", F.floor(F.col("at") / step))
    found = drawn.join(cells, ["i", "cell"]).where("at >= lo and at < hi")
    kinds = dict(df.dtypes)
    return found.groupBy("record").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).cast(kinds[f]).alias(f) for i, f in enumerate(fields)])


def linkage_summary(synthetic: DataFrame, classes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Exact matches of synthetic records with classes, null-safe: match rate, unique rate, expected correct matches."""
    c = classes.select(*[F.col(f).alias(f"c_{f}") for f in fields], "k")
    on = [F.col(f).eqNullSafe(F.col(f"c_{f}")) for f in fields]
    j = synthetic.join(c, on, "left")
    return j.agg(F.count("*").alias("synthetic_records"), share(F.count("k"), F.count("*")).alias("exact_match_rate"), share(F.count_if(F.col("k") == 1), F.count("*")).alias("unique_match_rate"), F.round(F.coalesce(F.sum(F.lit(1.0) / F.col("k")), F.lit(0.0)), 9).alias("expected_correct_matches"))


BLOCK = 100


def permutation_counts(df: DataFrame) -> DataFrame:
    """(census_tract, cell, pair, who, n): records of each tract by age-sex cell and race-ethnicity pair; nulls are one literal value."""
    keys = df.groupBy(*DEMO_GEO).agg(F.count("*").alias("n")).select(*[F.coalesce(c, F.lit(MISSING)).alias(c) for c in DEMO_GEO], "n")
    who = F.when(F.col("derived_ethnicity") != NON_HISPANIC, 0).when(F.col("derived_race") == BLACK, 1).when(F.col("derived_race") == WHITE, 2).otherwise(0)
    coded = keys.select("census_tract", F.xxhash64("applicant_age", "applicant_sex").alias("cell"), F.xxhash64("derived_race", "derived_ethnicity").alias("pair"), who.alias("who"), "n")
    return coded.groupBy("census_tract", "cell", "pair", "who").agg(F.sum("n").alias("n"))


def _permuted(base: DataFrame, by: list[str], iterations: int, seed: int) -> DataFrame:
    """(by, r, o): ratios of uniqueness rates of shuffled labels, a row for each iteration, and the observed one.

    A shuffled tract is a table of cells by pairs with the observed margins, so it is drawn as one (multivariate hypergeometric) from the
    tract's counts. A task gets a tract's counts, whatever its records, for a block of iterations with a seed of its own.
    """

    def tract(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf.groupby("cell")["n"].sum().sort_index().to_numpy()
        pairs = pdf.groupby("pair").agg(n=("n", "sum"), who=("who", "first")).sort_index()
        size = min(BLOCK, iterations - key[1] * BLOCK)
        rng = np.random.default_rng(key_seed(seed, *key[:2]))
        left = np.tile(pairs["n"].to_numpy(), (size, 1))
        out = np.zeros((size, 3), np.int64)
        for c in cells:
            need, rest = np.full(size, c), left.sum(axis=1)
            for j, w in enumerate(pairs["who"]):
                rest = rest - left[:, j]
                got = rng.hypergeometric(left[:, j], rest, need)
                left[:, j] -= got
                need = need - got
                out[:, w] += got == 1
        own = dict(zip(by, key[2:], strict=True))
        return pd.DataFrame({**own, "iteration": key[1] * BLOCK + np.arange(size), "ub": out[:, 1], "uw": out[:, 2]})

    kinds = "".join(f"{c} {base.schema[c].dataType.simpleString()}, " for c in by)
    blocks = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // BLOCK))))
    sums = blocks.groupBy("census_tract", "block", *by).applyInPandas(tract, f"{kinds}iteration int, ub long, uw long").groupBy(*by, "iteration").agg(F.sum("ub").alias("ub"), F.sum("uw").alias("uw"))
    n = lambda w: F.coalesce(F.sum(F.when(F.col("who") == w, F.col("n"))), F.lit(0).cast("long"))
    u = lambda w: F.count_if((F.col("who") == w) & (F.col("n") == 1))
    seen = base.groupBy(*by).agg(n(1).alias("nb"), n(2).alias("nw"), u(1).alias("ob"), u(2).alias("ow"))
    ratio = lambda b, w: (F.col(b) / F.nullif(F.col("nb"), F.lit(0))) / F.nullif(F.col(w) / F.nullif(F.col("nw"), F.lit(0)), F.lit(0.0))
    both = sums.join(F.broadcast(seen), by) if by else sums.crossJoin(seen)  # seen: one row for each group
    return both.select(*by, ratio("ub", "uw").alias("r"), ratio("ob", "ow").alias("o")).where("r is not null")


def _null_summary(per: DataFrame, by: list[str]) -> DataFrame:
    per = per.withColumn("m", F.mean("r").over(Window.partitionBy(*by)))  # rows: the iterations
    return per.groupBy(*by).agg(
        F.round(F.max("o"), 9).alias("observed_ratio"), F.round(F.max("m"), 9).alias("null_mean"), F.round(F.stddev_samp("r"), 9).alias("null_sd"), F.round(F.percentile("r", F.lit(0.025)), 9).alias("null_low"),
        F.round(F.percentile("r", F.lit(0.975)), 9).alias("null_high"), F.round((F.count_if(F.abs(F.col("r") - F.col("m")) >= F.abs(F.col("o") - F.col("m"))) + 1) / (F.count("*") + 1), 9).alias("p_value"), F.count("*").alias("iterations"),
    )


def permutation_null(df: DataFrame, iterations: int = 1000, seed: int = SEED) -> DataFrame:
    """Ratio of uniqueness rates when (race, ethnicity) labels are shuffled inside each tract; one row."""
    return _null_summary(_permuted(permutation_counts(df), [], iterations, seed), [])


def holm(df: DataFrame, p: str = "p_value") -> DataFrame:
    """Add holm_p_value: p-values of a family of few tests, each times the number of those not smaller, never below a smaller one's, at most 1."""
    everything, order = Window.partitionBy(), Window.orderBy(p)  # a few rows
    times = F.col(p) * (F.count("*").over(everything) - F.row_number().over(order) + 1)
    return df.withColumn("times", times).withColumn("holm_p_value", F.round(F.least(F.lit(1.0), F.max("times").over(Window.orderBy(p, "times"))), 9)).drop("times")


def quintile_permutation(df: DataFrame, quintiles: DataFrame, iterations: int = 1000, seed: int = SEED) -> DataFrame:
    """The permutation null in each tract quintile (census_tract, quintile), with p-values adjusted by Holm. Tracts without a quintile are out."""
    base = permutation_counts(df).join(small_table(quintiles.select("census_tract", "quintile"), "quintiles"), "census_tract")
    return holm(_null_summary(_permuted(base, ["quintile"], iterations, seed), ["quintile"]))


def _poisson_steps(top: int = 12) -> list[float]:
    """Chances that a Poisson count of mean 1 is at most 0, 1, ..."""
    return [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(top)]


def bootstrap_ratio(tracts: DataFrame, replicates: int = 2000, seed: int = SEED) -> DataFrame:
    """Percentile interval of the size-matched ratio over resampled tracts: in each replicate a tract comes as often as a Poisson count of mean 1, from its md5 uniform."""
    u = md5_uniform(F.lit(str(seed)), F.col("census_tract"), F.col("replicate").cast("string"))
    weight = reduce(Column.__add__, [(u >= F.lit(p)).cast("int") for p in _poisson_steps()])
    drawn = tracts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight).where("w > 0")
    s = drawn.groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("nb", "nw", "ub", "uw")])
    r = s.where("nb > 0 and nw > 0 and uw > 0").select((F.col("ub") / F.col("nb") / (F.col("uw") / F.col("nw"))).alias("r"))
    return r.agg(F.round(F.percentile("r", F.lit(0.025)), 9).alias("ratio_ci_low"), F.round(F.percentile("r", F.lit(0.975)), 9).alias("ratio_ci_high"), F.count("*").alias("usable_replicates"))


def decision(null: DataFrame, matched: DataFrame, interval: DataFrame) -> DataFrame:
    """Proceed only if the observed ratio beats the null, the matched comparison has power and its interval lies above 1."""
    one = null.crossJoin(matched).crossJoin(interval)  # one row each
    keep = (F.col("observed_ratio") > F.col("null_high")) & (F.col("p_value") < 0.05) & ~F.col("underpowered") & (F.col("ratio_ci_low") > 1)
    return one.select("observed_ratio", "null_high", "p_value", "underpowered", "ratio_ci_low", F.when(F.coalesce(keep, F.lit(False)), "proceed").otherwise("withdraw").alias("decision"))


def noised_counts(counts: DataFrame, column: str, epsilon: float, key: Sequence[str], sensitivity: float = 1.0, seed: int = SEED) -> DataFrame:
    """Laplace noise on aggregated counts, rounded and not below 0; the uniforms hang on the keys and the seed."""
    u = md5_uniform(F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in key]) - 0.5
    noise = -F.lit(sensitivity / epsilon) * F.signum(u) * F.log1p(-2 * F.abs(u) * (1 - 1e-12))
    return counts.withColumn(column, F.greatest(F.round(F.col(column) + noise), F.lit(0)).cast("long"))
