"""Least squares on dyad tables: normal equations by aggregation, solves of the size of the coefficients on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.functions.linear import safe_solve
from relata.operators.design import cross_products, linear_predictor
from relata.session import written


def normal_equations(design: DataFrame, names: Sequence[str], by: Sequence[str] = (), response: str = "y", weight=None) -> dict[tuple, tuple[np.ndarray, np.ndarray, int]]:
    """X'WX, X'Wy and the number of cells for each network; the driver gets p^2 numbers per network."""
    by, names = list(by), list(names)
    rows = cross_products(design if by else design.withColumn("_all", F.lit(1)), names, by or ["_all"], response, weight).collect()
    out: dict[tuple, tuple[np.ndarray, np.ndarray, int]] = {}
    place = {n: k for k, n in enumerate(names)}
    for r in rows:
        key = tuple(r[b] for b in by)
        xx, xy, _ = out.setdefault(key, (np.zeros((len(names), len(names))), np.zeros(len(names)), r["n_obs"]))
        if r["b"] == response:
            xy[place[r["a"]]] = r["value"] or 0.0
        else:
            xx[place[r["a"]], place[r["b"]]] = r["value"] or 0.0
    return out


def least_squares(design: DataFrame, names: Sequence[str], by: Sequence[str] = (), response: str = "y") -> dict[tuple, np.ndarray]:
    """Coefficients per network; minimum norm where the design is deficient."""
    return {k: safe_solve(xx, xy) for k, (xx, xy, _) in normal_equations(design, names, by, response).items()}


def penalised_paths(design: DataFrame, names: Sequence[str], penalty: float = 0.0, response: str = "y") -> dict[int, np.ndarray]:
    """Coefficients of each period under a penalty on first differences; without it they are the periods' least squares."""
    parts = normal_equations(design, names, ["t"], response)
    periods = sorted(k[0] for k in parts)
    p, n = len(names), len(periods)
    a, b = np.zeros((n * p, n * p)), np.zeros(n * p)
    for k, t in enumerate(periods):
        s = slice(k * p, (k + 1) * p)
        a[s, s], b[s] = parts[(t,)][0], parts[(t,)][1]
        if k:
            d = np.zeros((p, n * p))
            d[:, s], d[:, (k - 1) * p : k * p] = np.eye(p), -np.eye(p)
            a += penalty * d.T @ d
    beta = safe_solve(a, b)
    return {t: beta[k * p : (k + 1) * p] for k, t in enumerate(periods)}


def sandwich(design: DataFrame, names: Sequence[str], residual: str = "residual", cluster: str = "dyad") -> np.ndarray:
    """Covariance of the coefficients from scores summed per unordered pair (dyad) or per cell (none)."""
    names = list(names)
    seen = design.where(F.col(residual).isNotNull())
    scores = [(F.col(n) * F.col(residual)).alias(n) for n in names]
    if cluster == "dyad":
        grouped = seen.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), *scores).groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in names])
    elif cluster == "none":
        grouped = seen.select(*scores)
    else:
        raise ValueError("cluster is dyad or none")
    p = len(names)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s{x}_{y}") for x, a in enumerate(names) for y, b in enumerate(names) if y >= x]
    row = grouped.agg(*sums).first()
    meat = np.array([[row[f"s{min(x, y)}_{max(x, y)}"] or 0.0 for y in range(p)] for x in range(p)])
    bread = np.linalg.pinv(normal_equations(seen, names, (), residual)[()][0])
    return bread @ meat @ bread


def additive_effects(dyads: DataFrame, sweeps: int = 10, value: str = "y", checkpoint_every: int = 4) -> tuple[DataFrame, DataFrame, float]:
    """mu, and tables (actor, effect) of row and column effects, by alternating least squares over observed cells.

    A sweep is two group-bys with partial sums. The effect tables are one row per actor; they are written every
    few sweeps, so the plan stays short and a lost executor costs little.
    """
    cells = written(dyads.where(F.col(value).isNotNull()).select("i", "j", F.col(value).alias("y")), "cells")
    mu = cells.agg(F.avg("y")).first()[0] or 0.0
    a = cells.select(F.col("i").alias("actor")).distinct().withColumn("effect", F.lit(0.0))
    b = cells.select(F.col("j").alias("actor")).distinct().withColumn("effect", F.lit(0.0))
    for sweep in range(sweeps):
        other = b.select(F.col("actor").alias("j"), F.col("effect").alias("e"))
        a = cells.join(other, "j").groupBy(F.col("i").alias("actor")).agg(F.avg(F.col("y") - mu - F.col("e")).alias("effect"))
        other = a.select(F.col("actor").alias("i"), F.col("effect").alias("e"))
        b = cells.join(other, "i").groupBy(F.col("j").alias("actor")).agg(F.avg(F.col("y") - mu - F.col("e")).alias("effect"))
        if (sweep + 1) % checkpoint_every == 0:
            a, b = written(a, "effects"), written(b, "effects")
    return a, b, mu


def degrees_of_freedom(p_dyad: int, n_row: int, n_col: int | None, rank: int, symmetric: bool) -> int:
    """Parameters of the mean: intercept and coefficients, centred effects of active actors, and identified factors."""
    if symmetric:
        return p_dyad + 1 + (n_row - 1) + (rank * n_row - rank * (rank - 1) // 2 if rank else 0)
    n_col = n_row if n_col is None else n_col
    return p_dyad + 1 + (n_row - 1) + (n_col - 1) + rank * (n_row + n_col - rank)


def variance_components(residuals: DataFrame, a: DataFrame, b: DataFrame, residual: str = "residual") -> DataFrame:
    """One row: va, cab, vb, rho, ve of row and column effects and of the residuals of opposite pairs."""
    both = a.select("actor", F.col("effect").alias("a")).join(b.select("actor", F.col("effect").alias("b")), "actor", "full")
    effects = both.agg(F.var_samp("a").alias("va"), F.covar_samp("a", "b").alias("cab"), F.var_samp("b").alias("vb"))
    back = residuals.select(F.col("t"), F.col("j").alias("i"), F.col("i").alias("j"), F.col(residual).alias("_b"))
    pairs = residuals.join(back, ["t", "i", "j"], "left").where("i <> j")
    noise = pairs.agg(F.try_divide(F.covar_pop(residual, "_b"), F.sqrt(F.var_pop(residual) * F.var_pop("_b"))).alias("rho"), F.avg(F.col(residual) * F.col(residual)).alias("ve"))
    return effects.crossJoin(noise)


def with_residuals(design: DataFrame, beta: dict[str, float], response: str = "y", name: str = "residual") -> DataFrame:
    fitted = linear_predictor(design, beta, "eta")
    return fitted.withColumn(name, F.col(response) - F.col("eta"))
