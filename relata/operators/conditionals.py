"""Parameters of the conditional distributions that a sweep of the sampler draws from, as plans over long tables.

Each is a group-by or window over cells, dyads or paths, so that a sweep's deterministic part can be computed, or
checked, for a network that no worker holds: only the parameters, a few numbers per actor or period, leave the tables.
Cells without a value have no part in any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_scale(pairs: DataFrame, rho: float, shape: float = 0.5, rate: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(shape, rate) of the inverse gamma of the residual variance, from residuals (e, e_back) of pairs with reciprocity rho."""
    e, back = F.col("e"), F.col("e_back")
    ss = (F.sum(e * e + back * back) - 2 * rho * F.sum(e * back)) / (1 - rho * rho)
    return pairs.where("e is not null and e_back is not null").groupBy(*by).agg((F.lit(shape) + F.count("*")).alias("shape"), (F.lit(rate) + ss / 2).alias("rate"))


def cell_scale(cells: DataFrame, shape: float = 0.5, rate: float = 0.5, by: Sequence[str] = (), value: str = "e") -> DataFrame:
    """(shape, rate) of the inverse gamma of the variance of independent cells."""
    return cells.where(F.col(value).isNotNull()).groupBy(*by).agg((F.lit(shape) + F.count("*") / 2).alias("shape"), (F.lit(rate) + F.sum(F.col(value) * F.col(value)) / 2).alias("rate"))


def effects(cells: DataFrame, actor: str, s2: float, prior_variance: float, by: Sequence[str] = (), value: str = "e") -> DataFrame:
    """(actor, mean, precision) of the independent normals of additive effects, given what the rest of the model leaves of the cells."""
    known = cells.where(F.col(value).isNotNull()).groupBy(*by, F.col(actor).alias("actor")).agg(F.sum(value).alias("_sum"), (F.count("*") / s2 + 1 / prior_variance).alias("precision"))
    return known.select(*by, "actor", (F.col("_sum") / s2 / F.col("precision")).alias("mean"), "precision")


def effect_covariance(a: DataFrame, b: DataFrame, df: float = 4.0, prior: float = 1.0) -> DataFrame:
    """One row (df, saa, sab, sbb): the Wishart's parameters of the covariance of row and column effects of the same actors."""
    both = a.select("actor", F.col("effect").alias("a")).join(b.select("actor", F.col("effect").alias("b")), "actor")
    x, y = F.col("a"), F.col("b")
    return both.agg((F.lit(df) + F.count("*")).alias("df"), (F.lit(prior) + F.sum(x * x)).alias("saa"), F.sum(x * y).alias("sab"), (F.lit(prior) + F.sum(y * y)).alias("sbb"))


def coefficients(design: DataFrame, names: Sequence[str], s2: float, prior_variance: float, response: str = "y") -> DataFrame:
    """(name, mean, sd) of the normal of the coefficients with independent priors; only sums of products reach the driver."""
    known = design.where(F.col(response).isNotNull())
    sums = known.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, response])]).first()
    p = len(names)
    xx = np.array([[sums[f"{i}_{j}"] or 0.0 for j in range(p)] for i in range(p)], float)
    xy = np.array([sums[f"{i}_{p}"] or 0.0 for i in range(p)], float)
    cov = np.linalg.inv(xx / s2 + np.eye(p) / prior_variance)
    mean = cov @ xy / s2
    return design.sparkSession.createDataFrame([(n, float(m), float(v**0.5)) for n, m, v in zip(names, mean, np.diag(cov))], "name string, mean double, sd double")


def factors(cells: DataFrame, positions: DataFrame, s2: float, value: str = "e") -> DataFrame:
    """(i, mean_1, mean_2, p_11, p_12, p_22) of the normals of two-dimensional positions u of senders with standard normal priors, given receivers' (actor, u)."""
    v = positions.select(F.col("actor").alias("j"), F.col("u")[0].cast("double").alias("v1"), F.col("u")[1].cast("double").alias("v2"))
    e, x, y = F.col(value), F.col("v1"), F.col("v2")
    sums = cells.where(e.isNotNull()).join(v, "j").groupBy("i").agg((1 + F.sum(x * x) / s2).alias("p_11"), (F.sum(x * y) / s2).alias("p_12"), (1 + F.sum(y * y) / s2).alias("p_22"), (F.sum(e * x) / s2).alias("_l1"), (F.sum(e * y) / s2).alias("_l2"))
    det = F.col("p_11") * F.col("p_22") - F.col("p_12") * F.col("p_12")
    first, second = (F.col("p_22") * F.col("_l1") - F.col("p_12") * F.col("_l2")) / det, (F.col("p_11") * F.col("_l2") - F.col("p_12") * F.col("_l1")) / det
    return sums.select("i", first.alias("mean_1"), second.alias("mean_2"), "p_11", "p_12", "p_22")


# Bounds of latent responses


def binary_bounds(cells: DataFrame) -> DataFrame:
    """cells (y, ...) with the bounds low and high of the latent response: its sign; none where y is missing."""
    return cells.withColumn("low", F.when(F.col("y") > 0, 0.0)).withColumn("high", F.when(F.col("y") <= 0, 0.0))


def ordinal_bounds(cells: DataFrame, by: Sequence[str] = ("t",)) -> DataFrame:
    """(by, y, low, high): between the largest latent response of the levels below and the least of those above."""
    levels = cells.where("y is not null").groupBy(*by, "y").agg(F.max("z").alias("_most"), F.min("z").alias("_least"))
    w = Window.partitionBy(*by).orderBy("y")
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return levels.select(*by, "y", F.max("_most").over(below).alias("low"), F.min("_least").over(above).alias("high"))


def censored_bounds(cells: DataFrame, most: int, by: Sequence[str] = ("t", "i")) -> DataFrame:
    """Cells (y 0 or 1, z) with the bounds low and high of z when a sender names at most `most`: named ones are positive and above all others, others are below them, and negative if more could have been named."""
    w = Window.partitionBy(*by)
    named = F.col("y") > 0
    full = F.sum(named.cast("int")).over(w) >= most
    top = F.max(F.when(~named, F.col("z"))).over(w)
    least = F.min(F.when(named, F.col("z"))).over(w)
    known = cells.where("y is not null")
    return known.withColumn("low", F.when(named, F.greatest(F.lit(0.0), top))).withColumn("high", F.when(~named, F.when(full, least).otherwise(F.lit(0.0))))


def ranked_bounds(cells: DataFrame, most: int, by: Sequence[str] = ("t", "i")) -> DataFrame:
    """Cells (y: rank, larger is stronger, 0 for unnamed; z) with the bounds of z: between the next ranks; unnamed ones are below the weakest, and negative if more could have been named."""
    w, known = Window.partitionBy(*by), cells.where("y is not null")
    named = F.col("y") > 0
    full = F.sum(named.cast("int")).over(w) >= most
    top = F.max(F.when(~named, F.col("z"))).over(w)
    least = F.min(F.when(named, F.col("z"))).over(w)
    order = Window.partitionBy(*by).orderBy("y")
    below = F.max(F.when(named, F.col("z"))).over(order.rangeBetween(Window.unboundedPreceding, -1))
    above = F.min(F.when(named, F.col("z"))).over(order.rangeBetween(1, Window.unboundedFollowing))
    low = F.when(named, F.greatest(F.lit(0.0), top, below))
    return known.withColumn("low", low).withColumn("high", F.when(named, above).when(full, least).otherwise(F.lit(0.0)))


# Paths


def autoregression_conditional(steps: DataFrame, sigma2: float, mean: float = 0.9, sd: float = 0.1, weight: Column | None = None) -> DataFrame:
    """One row (mean, precision): the normal of the coefficient of an AR(1) process given transitions (value, before), before its truncation."""
    w = F.lit(1.0) if weight is None else weight
    x, y = F.col("before"), F.col("value")
    sums = steps.agg((F.sum(w * x * x) / sigma2 + 1 / sd**2).alias("precision"), (F.sum(w * x * y) / sigma2 + mean / sd**2).alias("_l"))
    return sums.select((F.col("_l") / F.col("precision")).alias("mean"), "precision")


def innovation_scale(steps: DataFrame, rho: float, shape: float = 2.0, rate: float = 1.0, weight: Column | None = None) -> DataFrame:
    """One row (shape, rate): the inverse gamma of the innovation variance given transitions; weights of 0 are no transitions."""
    w = F.lit(1.0) if weight is None else weight
    off = F.col("value") - rho * F.col("before")
    return steps.agg((F.lit(shape) + F.sum((w > 0).cast("int")) / 2).alias("shape"), (F.lit(rate) + F.sum(w * off * off) / 2).alias("rate"))


def heavy_tail_weights(steps: DataFrame, rho: float, sigma2: float, df: float, dimension: int = 1) -> DataFrame:
    """Transitions with the mean `weight` of the gamma that mixes a normal to a Student-t innovation."""
    off = F.col("value") - rho * F.col("before")
    return steps.withColumn("weight", (df + dimension) / (df + off * off / sigma2))


def reset_probability(steps: DataFrame, rho: float, sigma2: float, prior_variance: float, rate: float) -> DataFrame:
    """Transitions with the probability `reset` that the path begins anew from its prior instead of going on."""
    off = F.col("value") - rho * F.col("before")
    go_on = -0.5 * np.log(sigma2) - off * off / (2 * sigma2)
    anew = -0.5 * np.log(prior_variance) - F.col("value") * F.col("value") / (2 * prior_variance)
    return steps.withColumn("log_odds", float(np.log(rate / (1 - rate))) + anew - go_on).withColumn("reset", 1 / (1 + F.exp(-F.col("log_odds"))))


def path_energy(paths: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
    """(key, energy): x'Qx of each path (key, r, x) under a precision (r, s, value); places that a path lacks count as 0."""
    here, there = paths.select(*key, "r", "x"), paths.select(*key, F.col("r").alias("s"), F.col("x").alias("z"))
    near = here.join(F.broadcast(prior.where("value <> 0")), "r")  # as many rows as periods squared at most
    return near.join(there, [*key, "s"], "left").groupBy(*key).agg(F.sum(F.col("x") * F.col("value") * F.coalesce("z", F.lit(0.0))).alias("energy"))


def path_prior(kind: str, n: int, rho: float = 0.9, sigma2: float = 1.0, level: float = 0.01, spark=None) -> DataFrame:
    """(r, s, value): the prior precision of a path of n periods, as the sampler and the point estimates use it."""
    from relata.plans.gibbs import path_precision

    q = path_precision(n, kind, rho, sigma2, level=level)
    return spark.createDataFrame([(int(r), int(s), float(q[r, s])) for r in range(n) for s in range(n)], "r int, s int, value double")


def filtered_paths(cells: DataFrame, key: Sequence[str], rho: float, sigma2: float, s2: float, value: str = "e") -> DataFrame:
    """(key, t, filtered, smoothed, variance): means and filtered variances of stationary AR(1) paths that are observed with independent noise, as often per period as there are cells.

    A path is one array, filtered forwards and smoothed backwards by two folds. Periods between a key's first and last cells have to be there; periods without a value count as unobserved.
    """
    seen = cells.groupBy(*key, "t").agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"))
    paths = seen.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "n", "sum"))).alias("p"))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(sigma2 / (1 - rho * rho)).alias("v"), F.array().cast("array<struct<t:int,m:double,v:double>>").alias("all"))

    def forward(s: Column, x: Column) -> Column:
        first = F.size(s["all"]) == 0
        m, v = F.when(first, 0.0).otherwise(rho * s["m"]), F.when(first, s["v"]).otherwise(rho * rho * s["v"] + sigma2)
        new_v = 1 / (1 / v + x["n"] / s2)
        new_m = new_v * (m / v + x["sum"] / s2)
        return F.struct(new_m.alias("m"), new_v.alias("v"), F.concat(s["all"], F.array(F.struct(x["t"].cast("int").alias("t"), new_m.alias("m"), new_v.alias("v")))).alias("all"))

    forwards = paths.select(*key, F.aggregate("p", start, forward)["all"].alias("f"))
    begin = F.struct(F.lit(0.0).alias("m"), F.array().cast("array<struct<t:int,filtered:double,smoothed:double,variance:double>>").alias("all"))

    def backward(s: Column, x: Column) -> Column:
        gain = rho * x["v"] / (rho * rho * x["v"] + sigma2)
        m = F.when(F.size(s["all"]) == 0, x["m"]).otherwise(x["m"] + gain * (s["m"] - rho * x["m"]))
        return F.struct(m.alias("m"), F.concat(s["all"], F.array(F.struct(x["t"].alias("t"), x["m"].alias("filtered"), m.alias("smoothed"), x["v"].alias("variance")))).alias("all"))

    return forwards.select(*key, F.inline(F.aggregate(F.reverse("f"), begin, backward)["all"]))


def propagated(last: DataFrame, rho: float, sigma2: float, horizon: int, value: str = "value") -> DataFrame:
    """`last` once for each of the next periods `ahead`, with mean and variance of an AR(1) path that goes on from the value."""
    ahead = last.withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    power = F.pow(F.lit(float(rho)), F.col("ahead"))
    return ahead.withColumn("mean", power * F.col(value)).withColumn("variance", sigma2 * (1 - power * power) / (1 - rho * rho))


def surface(design: DataFrame, beta: dict[str, float], a: DataFrame, b: DataFrame, positions: DataFrame | None = None, other: DataFrame | None = None) -> DataFrame:
    """design with `eta`: coefficients times covariates, both actors' effects, and the product of their positions; 0 for what an actor lacks."""
    from relata.operators.design import linear_predictor
    from relata.operators.dyads import dot

    out = linear_predictor(design, beta, "eta")
    out = out.join(a.select(F.col("actor").alias("i"), F.col("effect").alias("_a")), "i", "left").join(b.select(F.col("actor").alias("j"), F.col("effect").alias("_b")), "j", "left")
    total = F.col("eta") + F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))
    if positions is not None:
        other = positions if other is None else other
        out = out.join(positions.select(F.col("actor").alias("i"), F.col("u").alias("_u")), "i", "left").join(other.select(F.col("actor").alias("j"), F.col("u").alias("_v")), "j", "left")
        total = total + F.coalesce(dot("_u", "_v"), F.lit(0.0))
    return out.withColumn("eta", total).drop("_a", "_b", "_u", "_v")
