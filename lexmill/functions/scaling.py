"""Scaling laws: L = E + A / N**alpha + B / D**beta."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Constants of the published fits (Chinchilla; the survey's synthetic points) and the fit's bounds.
CHINCHILLA = {"E": 1.69, "A": 406.4, "B": 410.7, "alpha": 0.34, "beta": 0.28}
PUBLISHED = {"E": 2.69, "A": 1606.40, "B": 3210.70, "alpha": 0.34, "beta": 0.36}
UPPER = {"E": 10.0, "A": 1e6, "B": 1e6, "alpha": 1.0, "beta": 1.0}


def loss(n: Column, d: Column, k: dict = PUBLISHED) -> Column:
    return k["E"] + k["A"] / F.pow(n, F.lit(k["alpha"])) + k["B"] / F.pow(d, F.lit(k["beta"]))


def tokens_for(compute: Column, n: Column) -> Column:
    return compute / (6 * n)


def optimal(compute: Column, k: dict = PUBLISHED) -> dict[str, Column]:
    """The published rule: D / N = alpha B / (beta A)."""
    ratio = k["alpha"] * k["B"] / (k["beta"] * k["A"])
    n = F.sqrt(compute / (6 * ratio))
    return {"n_opt": n, "d_opt": ratio * n, "l_opt": loss(n, ratio * n, k)}


def true_optimal(compute: Column, k: dict = PUBLISHED) -> dict[str, Column]:
    """The minimiser of the law under 6 N D = compute."""
    a, b = k["alpha"], k["beta"]
    n = F.pow(F.lit(a * k["A"] / (b * k["B"])), F.lit(1 / (a + b))) * F.pow(compute / 6, F.lit(b / (a + b)))
    d = compute / (6 * n)
    return {"n_opt": n, "d_opt": d, "l_opt": loss(n, d, k)}


def isoflop_points(spark: SparkSession, k: dict = PUBLISHED) -> DataFrame:
    """72 synthetic points on the law: 9 budgets of 8 model sizes."""
    grid = spark.range(72).select(F.pow(F.lit(10.0), 17 + F.floor(F.col("id") / 8) / 2).alias("compute_budget"), F.pow(F.lit(10.0), 7 + (F.col("id") % 8) * 0.35).alias("parameters"))
    return grid.withColumn("final_loss", loss(F.col("parameters"), tokens_for(F.col("compute_budget"), F.col("parameters")), k))


def fit(points: DataFrame, rounds: int = 12, side: int = 15) -> dict[str, float]:
    """Least squares by variable projection: for each cell of an (alpha, beta) grid the linear part is solved.

    One aggregation a round gives every cell's normal equations; the grid then
    shrinks around the best cell. Falls back to the published constants where
    no cell can be solved (fewer than three points, say).
    """
    spark = points.sparkSession
    clean = points.select(F.col("parameters").alias("n"), F.col("compute_budget").alias("c"), F.col("final_loss").alias("y")).dropna().filter("n > 0 and c > 0")
    low, high = np.array([0.02, 0.02]), np.array([UPPER["alpha"], UPPER["beta"]])
    best: tuple | None = None
    for _ in range(rounds):
        step = (high - low) / (side - 1)
        cell = lambda k, i: (F.lit(float(low[k])) + i * float(step[k]))
        grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.struct(cell(0, F.floor(i / side)).alias("a"), cell(1, i % side).alias("b"))))
        spread = clean.select("n", "c", "y", grid.alias("g")).select("g.a", "g.b", "y", F.pow("n", -F.col("g.a")).alias("u"), F.pow(F.col("c") / (6 * F.col("n")), -F.col("g.b")).alias("v"))
        s = lambda x: F.sum(x)
        u, v, y = F.col("u"), F.col("v"), F.col("y")
        rows = spread.groupBy("a", "b").agg(F.count("*").alias("n"), s(u).alias("u"), s(v).alias("v"), s(u * u).alias("uu"), s(u * v).alias("uv"), s(v * v).alias("vv"), s(y).alias("y"), s(u * y).alias("uy"), s(v * y).alias("vy"), s(y * y).alias("yy")).collect()
        for r in rows:
            m = np.array([[r.n, r.u, r.v], [r.u, r.uu, r.uv], [r.v, r.uv, r.vv]], float)
            t = np.array([r.y, r.uy, r.vy], float)
            scale = np.sqrt(np.diag(m))
            if (scale <= 0).any():
                continue
            try:
                w = np.linalg.solve(m / np.outer(scale, scale), t / scale) / scale
            except np.linalg.LinAlgError:
                continue
            if (w < 0).any() or w[0] > UPPER["E"] or w[1] > UPPER["A"] or w[2] > UPPER["B"]:
                continue
            sse = float(r.yy - 2 * w @ t + w @ m @ w)
            if best is None or sse < best[0]:
                best = (sse, r.a, r.b, w)
        if best is None:
            return dict(CHINCHILLA)
        half = (high - low) / 6
        centre = np.array([best[1], best[2]])
        low, high = np.maximum(centre - half, 1e-3), np.minimum(centre + half, 1.0)
    return {"E": float(best[3][0]), "A": float(best[3][1]), "B": float(best[3][2]), "alpha": float(best[1]), "beta": float(best[2])}


def r_squared(points: DataFrame, k: dict) -> DataFrame:
    """1 - residual / total sum of squares; sums of squares around the mean from plain sums."""
    guess = loss(F.col("parameters"), tokens_for(F.col("compute_budget"), F.col("parameters")), k)
    y = F.col("final_loss")
    return points.agg((1 - F.sum(F.pow(y - guess, F.lit(2.0))) / (F.var_pop(y) * F.count(y))).alias("r2"))
