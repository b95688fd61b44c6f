"""Adjusted logistic models of denial whose widest field may have any number of levels."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.shared import discard, written

CATEGORICAL = ("applicant_age", "applicant_sex", "loan_type", "debt_to_income_ratio", "loan_purpose", "occupancy_type", "lien_status", "derived_dwelling_category")
CONTINUOUS = ("protected_income", "protected_loan_amount")
AREA = "protected_geography"
RIDGE = 1e-8
#: Cells that one task sums up; designs are laid out so many rows at a time.
FIT_CELLS, FIT_ROWS = 20_000, 2_000
#: Areas of all models whose sums the driver takes, and whose coefficients are broadcast; beyond, written tables and shuffled joins serve.
DRIVER_AREAS, BROADCAST_AREAS, DRIVER_TASKS = 2_000, 200_000, 16

_FACTS = "status string, record_count long, reference_n long, comparison_n long, reference_denial_rate double, comparison_denial_rate double"
_FOUND = "adjusted_log_odds_coefficient double, se double, average_marginal_effect_points double, converged boolean, iterations int"


def adjusted_disparity(rows: DataFrame, iterations: int = 100, tolerance: float = 1e-8, by: str = "configuration", names: Sequence[str] = ()) -> DataFrame:
    """Logistic models of denial on race and covariates by iteratively reweighted least squares; a row for each value of `by`, which is added if
    missing, and for each of `names`, which may have no rows.

    Records (or cells with a count n) collapse to covariate cells first. The geography's dummies, a tract each for a state or the nation,
    never meet in one matrix: any two of them differ in their records, so their block of the cross products is diagonal. A step sums, for each
    area, its weight, its residual and its products with the other columns; what is left of the other columns' matrix once the areas are
    taken out (the Schur complement) has a few dozen columns, those of the register's closed vocabularies, and it alone is solved on the
    driver. From that step each area's own follows. This is the step of the whole design, not an approximation.

    A step is one job for all models that haven't converged if they have DRIVER_AREAS areas at most, else two: tasks sum cells by area (a hot area's
    cells lie in many tasks), and the written sums give both the complement and the areas' coefficients for the next step.
    """
    spark = rows.sparkSession
    rows = rows if by in rows.columns else rows.withColumn(by, F.lit(""))
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    fields = (AREA, *CATEGORICAL)
    cells = rows.groupBy(by, "is_black", *CONTINUOUS, *fields).agg(F.sum(n).alias("n"), F.sum(F.col("is_denied") * n).alias("d"))
    logs = [F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0)))).alias(c) for c in CONTINUOUS]  # greatest() passes nulls over; medians fill them
    cells = written(cells.select(F.col(by).alias("by"), "is_black", "n", "d", *logs, *[F.coalesce(c, F.lit("Missing")).alias(c) for c in fields]), "model-cells")

    sides = {(r["by"], r["is_black"]): r for r in cells.groupBy("by", "is_black").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()}  # two rows a model
    facts = {}
    for name in sorted({k for k, _ in sides} | set(names)):
        of = [sides.get((name, i)) for i in (0, 1)]
        n0, n1 = (int(x["n"]) if x else 0 for x in of)
        facts[name] = (n0 + n1, n0, n1, *(float(x["d"]) / x["n"] if x else None for x in of))
    enough = sorted(k for k, f in facts.items() if min(f[1:3]) >= 2)
    out = [(k, "insufficient_retained_comparison", *f, None, None, None, False, 0) for k, f in facts.items() if k not in enough]

    medians = cells.groupBy("by").agg(*[F.percentile(c, F.lit(0.5), F.col("n")).alias(f"m_{c}") for c in CONTINUOUS])
    filled = cells.join(F.broadcast(medians), "by").select(*[c for c in cells.columns if c not in CONTINUOUS], *[F.coalesce(c, f"m_{c}", F.lit(0.0)).alias(c) for c in CONTINUOUS])  # a row for each model
    mean = lambda e: F.sum(e * F.col("n")) / F.sum("n")
    moments = {r["by"]: r for r in filled.groupBy("by").agg(F.min(AREA).alias("first"), *[e for c in CONTINUOUS for e in (mean(F.col(c)).alias(f"m_{c}"), mean(F.col(c) * F.col(c)).alias(f"q_{c}"))]).collect()}
    scale = {k: [(m[f"m_{c}"], math.sqrt(max(m[f"q_{c}"] - m[f"m_{c}"] ** 2, 0.0))) for c in CONTINUOUS] for k, m in moments.items()}
    values = cells.select("by", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in CATEGORICAL])).alias("x")).select("by", "x.field", "x.value").distinct()
    levels: dict = {}
    for r in values.where(F.col("by").isin(enough)).collect():  # the closed vocabularies of eight fields
        levels.setdefault((r["by"], r["field"]), []).append(r["value"])
    place, width, varying = {}, {}, {}
    for k in enough:
        varying[k] = sum(sd > 1e-12 for _, sd in scale[k])
        at = 2 + varying[k]
        for c in CATEGORICAL:
            for v in sorted(levels[k, c])[1:]:
                place[k, c, v], at = at, at + 1
        width[k] = at

    numbers, spots = [f"x{i}" for i in range(len(CONTINUOUS))], [f"s{i}" for i in range(len(CATEGORICAL))]

    def laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The numbers scaled, those that vary first, and each field's column (-1: none). Plain columns, as lists would be taken apart anew in each step."""
        for pdf in batches:
            for k, part in pdf.groupby("by"):
                out = part[["by", "area", "is_black", "n", "d"]].copy()
                x = [(part[c] - m) / sd for c, (m, sd) in zip(CONTINUOUS, scale[k], strict=True) if sd > 1e-12]
                for i, c in enumerate(numbers):
                    out[c] = x[i] if i < len(x) else 0.0
                for c, f in zip(spots, CATEGORICAL, strict=True):
                    out[c] = part[f].map({v: place[k, f, v] for v in levels[k, f] if (k, f, v) in place}).fillna(-1).astype("int32")
                yield out

    base = F.lit(None)  # the first area in order has no dummy
    for k in enough:
        base = F.when(F.col("by") == k, moments[k]["first"]).otherwise(base)
    own = filled.where(F.col("by").isin(enough)).withColumn("area", F.when(F.col(AREA) != base, F.col(AREA)))
    tasks = max(1, -(-own.count() // FIT_CELLS)) if enough else 1
    # cells of an area lie together, so that a task has few areas' sums to yield; the other columns split a hot area over tasks
    dealt = own.repartitionByRange(tasks, "by", "area", *CONTINUOUS, *CATEGORICAL, "is_black").sortWithinPartitions("by", "area")
    kinds = ", ".join([*(f"{c} double" for c in numbers), *(f"{c} int" for c in spots)])
    ready = written(dealt.mapInPandas(laid_out, f"by string, area string, is_black int, n long, d long, {kinds}"), "model-rows")
    ready = ready.coalesce(1) if tasks == 1 else ready
    wide = max(width.values(), default=0)
    cols = [f"b{i}" for i in range(wide)]
    #: Sums: of an area (i = -1) its weight, residual, coefficient, last step and products; of the other columns (i >= 0) a row of their matrix and the residual.
    shape = f"by string, area string, i int, w double, g double, theta double, far double, {', '.join(f'{c} double' for c in cols)}"
    count = own.select("by", "area").distinct().count() if enough else 0
    near = count <= DRIVER_AREAS  # sums of so few areas may be taken to the driver: one job a step

    def table(name: str, area: list, i: np.ndarray, w: np.ndarray, g: np.ndarray, theta: np.ndarray, far: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        full = np.zeros((len(i), wide))
        full[:, : b.shape[1]] = b
        return pd.concat([pd.DataFrame({"by": name, "area": area, "i": i.astype(np.int32), "w": w, "g": g, "theta": theta, "far": far}), pd.DataFrame(full, columns=cols)], axis=1)

    def summed(beta: dict[str, np.ndarray], thetas: DataFrame | pd.DataFrame | None) -> DataFrame | pd.DataFrame:
        """Sums by area and of the other columns, at these coefficients; thetas: (by, area, theta, far) of the areas."""
        known = None if isinstance(thetas, DataFrame) else {c: {} if thetas is None else {k: dict(zip(v["area"], v[c], strict=True)) for k, v in thetas.groupby("by")} for c in ("theta", "far")}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {k: [np.zeros((len(v), len(v))), np.zeros(len(v)), 0.0] for k, v in beta.items()}
            seen = set()
            for pdf in batches:
                for name, every in pdf.groupby("by"):
                    seen.add(name)
                    h, g, _ = total[name]
                    for a in range(0, len(every), FIT_ROWS):
                        part = every.iloc[a : a + FIT_ROWS]
                        x = np.zeros((len(part), len(g) + 1))
                        x[:, 0], x[:, 1] = 1, part["is_black"]
                        x[:, 2 : 2 + varying[name]] = part[numbers[: varying[name]]]
                        x[np.arange(len(part))[:, None], part[spots].to_numpy()] = 1  # -1: the last column, cut off
                        x = x[:, :-1]
                        count, theta, moved = part["n"].to_numpy(float), *((part[c] if known is None else part["area"].map(known[c].get(name, {})).fillna(0.0)).to_numpy(float) for c in ("theta", "far"))
                        p = 1 / (1 + np.exp(-np.clip(x @ beta[name] + theta, -30, 30)))
                        weight, rest = count * np.maximum(p * (1 - p), 1e-9), part["d"].to_numpy(float) - count * p
                        wx = x * weight[:, None]
                        h += wx.T @ x
                        g += x.T @ rest
                        total[name][2] += float((count * p * (1 - p)).sum())
                        codes, areas = pd.factorize(part["area"])
                        if not len(areas):
                            continue
                        order = np.argsort(codes, kind="stable")
                        order = order[codes[order] >= 0]
                        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
                        add = lambda v: np.add.reduceat(v[order], starts, axis=0)  # noqa: B023, E731
                        first = order[starts]
                        yield table(name, list(areas), np.full(len(areas), -1), add(weight), add(rest), theta[first], moved[first], add(wx))
            for name in sorted(seen):
                h, g, m = total[name]
                yield table(name, [None] * len(g), np.arange(len(g)), np.full(len(g), m), g, np.zeros(len(g)), np.zeros(len(g)), h)

        part = ready.where(F.col("by").isin(list(beta)))
        if known is None:
            part = part.join(F.broadcast(thetas) if count <= BROADCAST_AREAS else thetas, ["by", "area"], "left").fillna(0.0, ["theta", "far"])
        if near and tasks <= DRIVER_TASKS:  # so few partial sums are added up on the driver
            rows = part.mapInPandas(lambda batches: iter([added(list(run(batches)))]), shape).toPandas()
            return added([rows])
        sums = part.mapInPandas(run, shape).groupBy("by", "area", "i").agg(*[F.sum(c).alias(c) for c in ("w", "g")], *[F.max(c).alias(c) for c in ("theta", "far")], *[F.sum(c).alias(c) for c in cols])
        return sums.toPandas() if near else written(sums, "model-sums")  # DRIVER_AREAS rows and a few dozen a model

    def added(parts: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat([pd.DataFrame({c: [] for c in ("by", "area", "i", "w", "g", "theta", "far", *cols)}), *parts])
        how = {c: "sum" for c in ("w", "g")} | {c: "max" for c in ("theta", "far")} | {c: "sum" for c in cols}
        return every.groupby(["by", "area", "i"], dropna=False).agg(how).reset_index()

    def taken_out(beta: dict[str, np.ndarray]):
        """What areas take off the others' matrix and residual, and how far an area moved."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {k: [np.zeros((len(v), len(v))), np.zeros(len(v)), 0.0] for k, v in beta.items()}
            for pdf in batches:
                for name, every in pdf[pdf["i"] < 0].groupby("by"):
                    h, g, far = total[name]
                    b, w, rest = every[cols].to_numpy()[:, : len(g)], every["w"].to_numpy() + RIDGE, every["g"].to_numpy() - RIDGE * every["theta"].to_numpy()
                    h -= (b / w[:, None]).T @ b
                    g -= b.T @ (rest / w)
                    total[name][2] = max(far, float(every["far"].max()))
            for name, (h, g, far) in total.items():
                yield table(name, [None] * len(g), np.arange(len(g)), np.zeros(len(g)), g, np.zeros(len(g)), np.full(len(g), far), h)

        return run

    def complement(sums: DataFrame | pd.DataFrame, beta: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray, float, float]]:
        """(matrix, residual, summed variance, longest step of an area) of each model, areas taken out."""
        sums_of = {c: "sum" for c in ("w", "g", *cols)} | {"far": "max"}
        if near:
            dense = pd.concat([sums[sums["i"] >= 0], *taken_out(beta)(iter([sums]))]).groupby(["by", "i"]).agg(sums_of).reset_index()
        else:
            part = sums.mapInPandas(taken_out(beta), shape)
            dense = sums.where("i >= 0").unionByName(part).groupBy("by", "i").agg(*[(F.max if f == "max" else F.sum)(c).alias(c) for c, f in sums_of.items()]).toPandas()  # a row for each column that isn't an area's
        found = {}
        for name, own in dense.sort_values("i").groupby("by"):
            found[name] = own[cols].to_numpy()[:, : len(own)], own["g"].to_numpy(), float(own["w"].iloc[0]), float(own["far"].max())
        return found

    def stepped(sums: DataFrame | pd.DataFrame, step: dict[str, np.ndarray]) -> DataFrame | pd.DataFrame:
        """Each area's coefficient and how far it moved, from the other columns' step."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for name, every in pdf[(pdf["i"] < 0) & pdf["by"].isin(list(step))].groupby("by"):
                    b, theta = every[cols].to_numpy()[:, : len(step[name])], every["theta"].to_numpy()
                    move = (every["g"].to_numpy() - RIDGE * theta - b @ step[name]) / (every["w"].to_numpy() + RIDGE)
                    yield pd.DataFrame({"by": name, "area": every["area"], "theta": theta + move, "far": np.abs(move)})

        kinds = "by string, area string, theta double, far double"
        if near:
            return pd.concat([pd.DataFrame({c: [] for c in ("by", "area", "theta", "far")}), *run(iter([sums]))])
        return sums.mapInPandas(run, kinds)  # read again from the written sums

    beta, thetas, last, old = {k: np.zeros(p) for k, p in width.items()}, None, dict.fromkeys(width, math.inf), None
    for k in range(iterations + 1):
        if not beta:
            break
        sums, step = summed(beta, thetas), {}
        if old is not None and not near:
            discard(old)  # what the present sums were made from
        for name, (h, g, m, far) in complement(sums, beta).items():
            h = h + np.diag([0.0] + [RIDGE] * (len(g) - 1))
            done = k > 0 and max(last[name], far) < tolerance
            if done or k == iterations:
                b, se = float(beta[name][1]), math.sqrt(max(np.linalg.pinv(h)[1, 1], 0))
                out.append((name, "estimated" if done else "maximum_iterations_reached", *facts[name], b, se, 100 * b * m / facts[name][0], done, k))
                continue
            step[name] = np.linalg.pinv(h) @ (g - RIDGE * np.concatenate([[0.0], beta[name][1:]]))
            last[name] = float(np.abs(step[name]).max())
        beta, thetas, old = {x: beta[x] + step[x] for x in step}, stepped(sums, step) if step else None, sums
    if old is not None and not near:
        discard(old)
    for old in (cells, ready):
        discard(old)
    found = spark.createDataFrame(sorted(out), f"{by} string, {_FACTS}, {_FOUND}")
    b, se = F.col("adjusted_log_odds_coefficient"), F.col("se")
    odds = {"adjusted_odds_ratio": F.exp(b), "odds_ratio_ci_low": F.exp(b - 1.96 * se), "odds_ratio_ci_high": F.exp(b + 1.96 * se)}  # beyond doubles: infinite
    return found.withColumns(odds).drop("se")
