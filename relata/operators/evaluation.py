"""Held-out accuracy and calibration of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.operators.running import running_sums

CLIP = 1e-12


def evaluate(predictions: DataFrame, family: str, y: str = "y", p: str = "predicted") -> DataFrame:
    """One row of scores. binary and cbin: brier, log_loss, auroc, auprc; normal: rmse, mae, log_density; poisson: rmse, log_density."""
    seen = predictions.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))
    error = F.col("y") - F.col("p")
    if family == "normal":
        scored = seen.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(error).alias("v"), F.avg(error * error).alias("m"))
        return scored.select("rmse", "mae", (-0.5 * F.log(2 * F.pi() * F.col("m")) - 0.5).alias("log_density"))
    if family == "poisson":
        rate = F.greatest(F.col("p"), F.lit(CLIP))
        terms = seen.withColumn("lf", log_factorial(F.col("y")))
        return terms.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.col("y") * F.log(rate) - rate - F.col("lf")).alias("log_density"))
    if family not in ("binary", "cbin"):
        raise ValueError(f"no scores for the family {family}")
    q = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP))
    seen = seen.withColumn("y", (F.col("y") > 0).cast("double"))
    basic = seen.agg(
        F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("brier"),
        (-F.avg(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("log_loss"),
        F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"),
    )
    # at each distinct score: misses below it, half of those at it, and the precision counted from above, weighted by the hits there
    steps = running_sums(seen.groupBy("p").agg(F.sum("y").alias("hits"), F.sum(1 - F.col("y")).alias("misses")), "p", ["hits", "misses"])
    hits, misses = F.col("hits"), F.col("misses")
    over = F.col("n1") - F.col("hits_upto") + hits
    precision = over / (over + F.col("n0") - F.col("misses_upto") + misses)
    curve = steps.crossJoin(F.broadcast(basic.select("n1", "n0"))).agg(F.try_divide(F.sum(hits * precision), F.sum(hits)).alias("auprc"), F.sum(hits * (F.col("misses_upto") - misses / 2)).alias("above"))
    auroc = F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("above") / (F.col("n1") * F.col("n0")))
    return basic.crossJoin(curve).select("brier", "log_loss", auroc.alias("auroc"), "auprc")


def log_factorial(y):
    """log y! by Stirling's series, shifted up by eight; absolute error below 1e-11 for whole y >= 0."""
    x = y + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    shift = y * 0.0
    for k in range(1, 9):
        shift = shift + F.log(y + float(k))
    return series - shift


def calibration(predictions: DataFrame, bins: int = 10, y: str = "y", p: str = "predicted") -> DataFrame:
    """(bin, n, mean_predicted, mean_observed) over equal-width bins of a predicted probability."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return predictions.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("mean_observed"))


def pit(draws: DataFrame, observed: DataFrame, discrete: bool = False, by: tuple = ("t", "i", "j"), seed: int = 29) -> DataFrame:
    """(by, pit) of observed values (by, y) in predictive draws (by, draw, value); randomised by a hash within the jump if discrete."""
    by = list(by)
    both = draws.join(observed.where("y is not null"), by)
    below, at = F.avg((F.col("value") < F.col("y")).cast("double")), F.avg((F.col("value") <= F.col("y")).cast("double"))
    u = (F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    made = both.groupBy(*by).agg(below.alias("lo"), at.alias("hi"))
    return made.select(*by, (F.col("lo") + u * (F.col("hi") - F.col("lo")) if discrete else F.col("hi")).alias("pit"))


def pit_summary(values: DataFrame, level: float = 0.9) -> DataFrame:
    """One row: n, mean, Kolmogorov-Smirnov distance from the uniform, and the share within the central interval."""
    low, pit_ = (1 - level) / 2, F.col("pit")
    basic = values.agg(F.count("*").alias("n"), F.avg("pit").alias("mean"), F.avg(pit_.between(low, 1 - low).cast("double")).alias("coverage"))
    steps = running_sums(values.where("pit is not null").groupBy("pit").agg(F.count("*").alias("c")), "pit", ["c"])
    gap = F.greatest(F.col("c_upto") / F.col("n") - pit_, pit_ - (F.col("c_upto") - F.col("c")) / F.col("n"))
    worst = steps.crossJoin(F.broadcast(basic.select("n"))).agg(F.max(gap).alias("ks"))
    return basic.crossJoin(worst).select("n", "mean", "ks", "coverage")
