"""Posterior summaries as queries over long tables of draws (chain, draw, term[, t], value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.operators.running import running_sums

Terms = Sequence[str]


def coefficients(draws: DataFrame, by: Terms = ("term",)) -> DataFrame:
    return draws.groupBy(*by).agg(F.avg("value").alias("estimate"))


def covariances(draws: DataFrame, by: Terms = ("term",), unit: Terms = ("chain", "draw")) -> DataFrame:
    """(by_a, by_b, value): sample covariances of all pairs of terms over draws."""
    a = draws.select(*unit, *[F.col(b).alias(f"{b}_a") for b in by], F.col("value").alias("x"))
    b = draws.select(*unit, *[F.col(b).alias(f"{b}_b") for b in by], F.col("value").alias("y"))
    return a.join(b, list(unit)).groupBy(*[f"{c}_{s}" for s in ("a", "b") for c in by]).agg(F.covar_samp("x", "y").alias("value"))


def intervals(draws: DataFrame, level: float = 0.95, by: Terms = ("term",)) -> DataFrame:
    low = (1 - level) / 2
    q = F.percentile("value", F.array(F.lit(low), F.lit(1 - low)))
    return draws.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("conf_low"), F.col("q")[1].alias("conf_high"))


def quantiles(draws: DataFrame, probs: Sequence[float] = (0.025, 0.5, 0.975), by: Terms = ("term",)) -> DataFrame:
    """(by, prob, value); works for any block of draws, multiplicative terms included."""
    q = F.percentile("value", F.array(*[F.lit(p) for p in probs]))
    return draws.groupBy(*by).agg(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), q.alias("value")).alias("q")).select(*by, F.inline("q"))


def tidy(draws: DataFrame, level: float = 0.95, by: Terms = ("term",)) -> DataFrame:
    """estimate, std_error, statistic, p_value (two-sided normal) and interval of each term."""
    from relata.functions.distributions import two_sided_p

    low = (1 - level) / 2
    q = F.percentile("value", F.array(F.lit(low), F.lit(1 - low)))
    base = draws.groupBy(*by).agg(F.avg("value").alias("estimate"), F.stddev_samp("value").alias("std_error"), q.alias("q"))
    z = F.try_divide("estimate", "std_error")
    return base.select(*by, "estimate", "std_error", z.alias("statistic"), two_sided_p(z).alias("p_value"), F.col("q")[0].alias("conf_low"), F.col("q")[1].alias("conf_high"))


def rhat(draws: DataFrame, by: Terms = ("term",), split: bool = False) -> DataFrame:
    """Potential scale reduction: sqrt of ((n-1)/n W + B/n) / W over chains, or over halves of chains; null for fewer than two or short chains."""
    by = list(by)
    unit = [*by, "chain"]
    if split:
        n = F.count("*").over(Window.partitionBy(*unit))
        k = F.row_number().over(Window.partitionBy(*unit).orderBy("draw"))
        half = F.floor(n / 2)
        draws = draws.withColumn("_k", k).withColumn("_h", half).where(F.col("_k") <= 2 * F.col("_h")).withColumn("_half", (F.col("_k") > F.col("_h")).cast("int"))
        unit = [*unit, "_half"]
    each = draws.groupBy(*unit).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    over = each.groupBy(*by).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"), F.count("*").alias("chains"), F.min("n").alias("least"))
    value = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w"))
    return over.select(*by, F.when((F.col("chains") >= 2) & (F.col("least") >= 2) & (F.col("w") > 0), value).alias("rhat"), "chains")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(values: Column, step: Callable[[Column], Column]) -> Column:
    """The sum of step over an array; entries of null count as 0."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + F.coalesce(step(x), F.lit(0.0)))


def effective_size(draws: DataFrame, by: Terms = ("term",)) -> DataFrame:
    """(by, ess): effective number of draws, summed over chains.

    From Geyer's initial monotone sequence: autocorrelations are added in pairs, each no larger than the one
    before, until a pair is negative. A chain's draws are an array, its lagged products are
    folds, and lags after the stop are not computed. Constant chains and those of fewer than four draws count in full.
    """
    by = list(by)
    ordered = draws.groupBy(*by, "chain").agg(F.sort_array(F.collect_list(F.struct("draw", F.col("value").cast("double").alias("value")))).alias("d"))
    values = F.transform("d", lambda x: x["value"])

    def of(c: Column) -> Column:
        n = F.size(c)
        lagged = lambda k: fold(F.zip_with(F.slice(c, F.lit(1), n - k), F.slice(c, k + 1, n - k), lambda x, y: x * y), lambda x: x) / (n - k)

        def total(variance: Column) -> Column:
            def step(state: Column, k: Column) -> Column:
                grown = lambda pair: F.struct((state["sum"] + F.least(pair, state["last"])).alias("sum"), F.least(pair, state["last"]).alias("last"), F.lit(False).alias("over"))
                end = F.struct(state["sum"].alias("sum"), state["last"].alias("last"), F.lit(True).alias("over"))
                after = let((lagged(2 * k - 1) + lagged(2 * k)) / variance, lambda pair: F.when(pair < 0, end).otherwise(grown(pair)))
                return F.when(state["over"], state).otherwise(after)

            begin = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("last"), F.lit(False).alias("over"))
            found = F.aggregate(F.sequence(F.lit(1), F.floor((n - 1) / 2).cast("int")), begin, step, lambda state: state["sum"])
            return F.least(n.cast("double"), n / F.greatest(F.lit(1e-12), 1 + 2 * found))

        return let(fold(c, lambda x: x * x) / n, lambda v: F.when((n < 4) | (v <= 0), n.cast("double")).otherwise(total(v)))

    centred = let(values, lambda v: let(fold(v, lambda x: x) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean)))
    return ordered.select(*by, let(centred, of).alias("ess")).groupBy(*by).agg(F.sum("ess").alias("ess"))


def multivariate_rhat(draws: DataFrame, term: str = "term", point: str = "t") -> DataFrame:
    """(term, mrhat, worst_split): Brooks and Gelman's multivariate factor of each coefficient path, and its worst split R-hat."""
    import pandas as pd

    worst = rhat(draws, (term, point), split=True).groupBy(term).agg(F.max("rhat").alias("worst_split"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=["chain", "draw"], columns=point, values="value").sort_index()
        chains = [g.to_numpy() for _, g in wide.groupby(level=0)]
        m, n = len(chains), min(map(len, chains))
        if m < 2 or n < 3:
            return pd.DataFrame({term: [pdf[term].iloc[0]], "mrhat": [np.nan]})
        w = np.mean([np.cov(c, rowvar=False).reshape(wide.shape[1], -1) for c in chains], axis=0)
        b = np.cov(np.stack([c.mean(0) for c in chains]), rowvar=False).reshape(wide.shape[1], -1)
        largest = np.max(np.real(np.linalg.eigvals(np.linalg.pinv(w) @ b)))
        return pd.DataFrame({term: [pdf[term].iloc[0]], "mrhat": [float(np.sqrt((n - 1) / n + (m + 1) / m * largest))]})

    return draws.groupBy(term).applyInPandas(one, f"`{term}` string, mrhat double").join(worst, term)


def pooled(fits: DataFrame, by: Terms = ("term",)) -> DataFrame:
    """Several fits (panel, by, estimate, std_error) pooled by inverse variance, with each panel's deviation and the share of shrinkage."""
    by = list(by)
    w = F.try_divide(F.lit(1.0), F.col("std_error") * F.col("std_error"))
    one = fits.groupBy(*by).agg(F.try_divide(F.sum(F.col("estimate") * w), F.sum(w)).alias("pooled"), F.sqrt(F.try_divide(F.lit(1.0), F.sum(w))).alias("pooled_se"), F.var_samp("estimate").alias("between"), F.avg(F.col("std_error") * F.col("std_error")).alias("within"))
    out = fits.join(one, by)
    return out.select("panel", *by, "estimate", "std_error", "pooled", "pooled_se", (F.col("estimate") - F.col("pooled")).alias("deviation"), F.try_divide(F.col("within"), F.col("within") + F.coalesce("between", F.lit(0.0))).alias("shrinkage"))


def snap_index(indicators: DataFrame, by: Terms = ("year",)) -> DataFrame:
    """Mean indicator per draw and period (and group), of (draw, actor, year, value)."""
    return indicators.groupBy("draw", *by).agg(F.avg("value").alias("index"))


def snap_summary(indicators: DataFrame, probs: Sequence[float] = (0.025, 0.1, 0.5, 0.9, 0.975), by: Terms = ("year",)) -> DataFrame:
    """Mean, standard deviation and quantiles, named q2_5 and so on, of the index over draws."""
    label = lambda p: f"q{p * 100:g}".replace(".", "_")
    q = F.percentile("index", F.array(*[F.lit(p) for p in probs]))
    out = snap_index(indicators, by).groupBy(*by).agg(F.avg("index").alias("mean"), F.stddev_samp("index").alias("sd"), q.alias("q"))
    return out.select(*by, "mean", "sd", *[F.col("q")[k].alias(label(p)) for k, p in enumerate(probs)])


def snap_groups(indicators: DataFrame, groups: DataFrame, **options) -> DataFrame:
    """snap_summary for each group of actors (actor, group)."""
    return snap_summary(indicators.join(groups, "actor"), by=("group", "year"), **options)


def snap_ranks(indicators: DataFrame, top: int = 3) -> DataFrame:
    """Per period the chance of rank 1 and of the first `top`, and mean and median rank, ranking periods within each draw."""
    order = Window.partitionBy("draw").orderBy(F.desc("index"))
    ranked = snap_index(indicators).withColumn("rank", F.rank().over(order))
    return ranked.groupBy("year").agg(F.avg((F.col("rank") == 1).cast("double")).alias("p_first"), F.avg((F.col("rank") <= top).cast("double")).alias("p_top"), F.avg("rank").alias("mean_rank"), F.percentile("rank", 0.5).alias("median_rank"))


def change_points(paths: DataFrame, prior: DataFrame, by: Terms = ("term",), threshold: float = 10.0) -> DataFrame:
    """Largest scaled first difference of each drawn path against that of prior paths of the same length.

    Bayes factor: the share of draws above the prior's 95 % quantile, over 0.05; and the most frequent period of the largest step.
    """
    by = list(by)

    def steps(table: DataFrame) -> DataFrame:
        path = Window.partitionBy(*by, "chain", "draw").orderBy("t")
        whole = Window.partitionBy(*by, "chain", "draw")
        d = table.withColumn("step", F.abs(F.col("value") - F.lag("value").over(path))).withColumn("sd", F.stddev_samp("value").over(whole))
        return d.where("step is not null").groupBy(*by, "chain", "draw").agg(F.max(F.col("step") / F.when(F.col("sd") > 0, F.col("sd"))).alias("largest"), F.max_by("t", "step").alias("at"))

    bar = steps(prior).groupBy(*by).agg(F.percentile("largest", 0.95).alias("bar"))
    seen = steps(paths).join(bar, by).groupBy(*by).agg((F.avg((F.col("largest") > F.col("bar")).cast("double")) / 0.05).alias("bayes_factor"), F.mode("at").alias("at"), F.avg("largest").alias("mean_largest"))
    return seen.withColumn("change", F.col("bayes_factor") >= threshold)


def waic(loglik: DataFrame, by: Terms = ("t", "i", "j")) -> DataFrame:
    """One row: elpd, effective parameters, waic and its standard error, from pointwise log-likelihoods of draws.

    Terms are shifted by each point's maximum before they are exponentiated.
    """
    by = list(by)
    top = loglik.groupBy(*by).agg(F.max("ll").alias("m"))
    point = loglik.join(top, by).groupBy(*by).agg((F.log(F.avg(F.exp(F.col("ll") - F.col("m")))) + F.first("m")).alias("lppd"), F.var_samp("ll").alias("p"))
    n = F.count("*")
    each = F.col("lppd") - F.col("p")
    return point.agg(F.sum(each).alias("elpd_waic"), F.sum("p").alias("p_waic"), (-2 * F.sum(each)).alias("waic"), (2 * F.sqrt(n * F.var_samp(each))).alias("se"), n.alias("n_obs"))


def psis_loo(loglik: DataFrame, by: Terms = ("t", "i", "j")) -> DataFrame:
    """(by, elpd, k): leave-one-out densities by Pareto-smoothed importance sampling (Vehtari, Gelman and Gabry, 2017).

    One aggregation brings a point's draws into a sorted array; the tail's fit is folds over it. k is null where
    the tail has fewer than five draws or no spread; weights are then the raw ones.
    """
    by = list(by)
    point = loglik.groupBy(*by).agg(F.sort_array(F.collect_list(-F.col("ll").cast("double"))).alias("r"))

    def of(s: Column) -> Column:
        """s: log ratios less their largest, in rising order, and the least log-likelihood."""
        w, n = s["w"], F.size(s["w"])
        size = F.floor(F.least(0.2 * n, 3 * F.sqrt(n))).cast("int")

        def density(weights: Column) -> Column:
            terms = F.zip_with(weights, w, lambda a, b: a - b)
            summed = lambda x: let(F.array_max(x), lambda top: F.log(fold(x, lambda v: F.exp(v - top))) + top)
            return summed(terms) + s["least"] - summed(weights)

        def smoothed(tail: Column) -> Column:
            cut = F.exp(F.get(w, n - size - 1))
            fitted = lambda p: cut + F.when(F.abs(tail["k"]) < 1e-9, -tail["sigma"] * F.log1p(-p)).otherwise(tail["sigma"] * (F.pow(1 - p, -tail["k"]) - 1) / tail["k"])
            last = F.transform(F.sequence(F.lit(1), size), lambda i: F.least(F.log(fitted((i - 0.5) / size)), F.lit(0.0)))
            return F.concat(F.slice(w, F.lit(1), n - size), last)

        raw = F.struct(density(w).alias("elpd"), F.lit(None).cast("double").alias("k"))
        excess = let(F.exp(F.get(w, n - size - 1)), lambda cut: F.transform(F.slice(w, n - size + 1, size), lambda x: F.exp(x) - cut))
        fit = lambda x: let(generalised_pareto(F.transform(x, lambda v: F.greatest(v, F.lit(1e-300)))), lambda tail: F.struct(density(smoothed(tail)).alias("elpd"), tail["k"].alias("k")))
        spread = lambda x: F.when(F.array_max(x) > 0, fit(x)).otherwise(raw)
        return F.when(size < 5, raw).otherwise(let(excess, spread))

    shifted = let(F.array_max("r"), lambda top: F.struct(F.transform("r", lambda x: x - top).alias("w"), (-top).alias("least")))
    return point.select(*by, let(shifted, of).alias("p")).select(*by, "p.elpd", "p.k")


def generalised_pareto(x: Column) -> Column:
    """Struct of shape k and scale sigma for a rising array of excesses: Zhang and Stephens (2009), with a weak prior on the shape."""
    n = F.size(x)
    m = 30 + F.floor(F.sqrt(n)).cast("int")
    quarter = F.greatest(F.get(x, F.floor(n / 4 + 0.5).cast("int") - 1), F.lit(1e-300))
    shape = lambda theta: fold(x, lambda v: F.log1p(-theta * v)) / n
    grid = let(F.struct((1 / F.array_max(x)).alias("a"), (3 * quarter).alias("q")), lambda c: F.transform(F.sequence(F.lit(1), m), lambda j: c["a"] + (1 - F.sqrt(m / (j - 0.5))) / c["q"]))

    def weighed(theta: Column) -> Column:
        profile = F.transform(theta, lambda th: let(shape(th), lambda sh: n * (F.log(-th / sh) - sh - 1)))
        weights = let(profile, lambda all_: F.transform(all_, lambda p: 1 / fold(all_, lambda q: F.exp(F.least(q - p, F.lit(700.0))))))
        return let(weights, lambda w: fold(F.zip_with(theta, w, lambda a, b: a * b), lambda v: v) / fold(w, lambda v: v))

    best = let(grid, weighed)
    return let(best, lambda t: let(shape(t), lambda k: F.struct(((n * k + 5) / (n + 10)).alias("k"), (-k / t).alias("sigma"))))


def saved_draws(draws: DataFrame, n: int, seed: int = 29) -> DataFrame:
    """n of the draws, taken by a hash, in order; all if there are no more."""
    unit = draws.select("chain", "draw").distinct()
    picked = unit.orderBy(F.xxhash64("chain", "draw", F.lit(seed)), "chain", "draw").limit(n)
    return draws.join(picked, ["chain", "draw"], "left_semi")


def weighted_quantile(values: DataFrame, probs: Sequence[float], value: str = "value", weight: str = "weight") -> DataFrame:
    """(prob, value): the least value at which the cumulative share of the weight reaches prob."""
    per = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(weight).alias("w"))
    total = per.agg(F.sum("w").alias("total"))
    share = running_sums(per, value, ["w"]).crossJoin(F.broadcast(total)).withColumn("share", F.col("w_upto") / F.col("total"))
    asked = values.sparkSession.createDataFrame([(float(p),) for p in probs], "prob double")
    return share.join(F.broadcast(asked), F.col("share") >= F.col("prob") - 1e-12).groupBy("prob").agg(F.min(value).alias("value"))
