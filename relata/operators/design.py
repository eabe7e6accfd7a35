"""Design columns: nodal and dyadic covariates, matching, scores and missingness."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.operators.running import running_sums

SUFFIXES = ("_row", "_col", "_dyad")


def suffixed(name: str, suffix: str) -> str:
    """name with the suffix once: `x.dyad` and `x_dyad` both give `x_dyad`."""
    word = suffix.lstrip("_")
    return re.sub(rf"[._]{word}$", "", name) + f"_{word}"


def nodal_pair(nodes: DataFrame, name: str, how: str, square: bool = True, levels: Sequence | None = None) -> DataFrame:
    """(i, j, value) or, for factors, (i, j, level, value), of a nodal attribute over all pairs.

    match: 1 if equal; absdiff: absolute difference; sum: the sum; factor: how many of the two are of each level.
    The diagonal is null if square. The pairs are an actor table times itself, which is the size of the result.
    """
    a = nodes.select(F.col("actor").alias("i"), F.col(name).alias("a"))
    b = nodes.select(F.col("actor").alias("j"), F.col(name).alias("b"))
    pairs = a.crossJoin(b)
    off = lambda c: F.when((F.col("i") == F.col("j")) & F.lit(square), None).otherwise(c).alias("value")
    if how == "match":
        return pairs.select("i", "j", off((F.col("a") == F.col("b")).cast("double")))
    if how == "absdiff":
        return pairs.select("i", "j", off(F.abs(F.col("a") - F.col("b")).cast("double")))
    if how == "sum":
        return pairs.select("i", "j", off((F.col("a") + F.col("b")).cast("double")))
    if how == "factor":
        found = nodes.select(F.col(name).alias("level")).where("level is not null").distinct() if levels is None else None
        found = found if found is not None else nodes.sparkSession.createDataFrame([(x,) for x in levels], ["level"])
        full = pairs.crossJoin(F.broadcast(found))
        return full.select("i", "j", "level", off((F.col("a") == F.col("level")).cast("double") + (F.col("b") == F.col("level")).cast("double")))
    raise ValueError(f"no pairing {how}")


def with_nodal(dyads: DataFrame, nodes: DataFrame, names: Sequence[str], side: str) -> DataFrame:
    """Nodal covariates of one side as columns with its suffix; nodes may have a period."""
    at = "i" if side == "row" else "j"
    key = [c for c in ("t",) if c in nodes.columns]
    picked = nodes.select(*key, F.col("actor").alias(at), *[F.col(n).cast("double").alias(suffixed(n, side)) for n in names])
    return dyads.join(picked, [*key, at], "left")


def design(dyads: DataFrame, dyadic: Sequence[str] = (), nodes: DataFrame | None = None, row: Sequence[str] = (), col: Sequence[str] = (), intercept: bool = True, listwise: bool = True) -> tuple[DataFrame, list[str]]:
    """dyads with the design columns, and their names.

    An intercept is added unless some covariate is constant. listwise: cells with a missing covariate become
    unobserved, and missing covariates 0; otherwise they stay null.
    """
    out = dyads
    for n in dyadic:
        out = out.withColumn(suffixed(n, "dyad"), F.col(n).cast("double"))
    names = [suffixed(n, "dyad") for n in dyadic]
    if nodes is not None:
        if row:
            out, names = with_nodal(out, nodes, row, "row"), names + [suffixed(n, "row") for n in row]
        if col:
            out, names = with_nodal(out, nodes, col, "col"), names + [suffixed(n, "col") for n in col]
    if listwise and names:
        gone = F.lit(False)
        for n in names:
            gone = gone | F.col(n).isNull()
        out = out.withColumn("y", F.when(gone, None).otherwise(F.col("y")))
        out = out.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in names else F.col(c) for c in out.columns])
    if intercept:
        spread = out.agg(*[F.var_samp(n).alias(n) for n in names]).first().asDict() if names else {}
        if all(v is None or v > 0 for v in spread.values()):
            out, names = out.withColumn("intercept", F.lit(1.0)), ["intercept", *names]
    return out, names


def propagate_missing(dyads: DataFrame, names: Sequence[str]) -> DataFrame:
    """y is null where any of the named covariates is."""
    gone = F.lit(False)
    for n in names:
        gone = gone | F.col(n).isNull()
    return dyads.withColumn("y", F.when(gone, None).otherwise(F.col("y")))


def cross_products(design: DataFrame, names: Sequence[str], by: Sequence[str] = ("t",), response: str = "y", weight: Column | None = None) -> DataFrame:
    """(by, a, b, value) of X'WX, with b = `response` for X'Wy, over cells with an observed response; one pass, partially summed."""
    by, names, w = list(by), list(names), F.lit(1.0) if weight is None else weight
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"{p}_{q}") for p, a in enumerate(names) for q, b in enumerate([*names, response]) if q >= p or b == response]
    wide = design.where(F.col(response).isNotNull()).groupBy(*by).agg(*sums, F.count("*").alias("n"))
    pairs = [(p, q) for p in range(len(names)) for q in range(len(names) + 1)]
    label = lambda q: names[q] if q < len(names) else response
    entries = F.array(*[F.struct(F.lit(names[p]).alias("a"), F.lit(label(q)).alias("b"), F.col(f"{min(p, q)}_{max(p, q)}" if q < len(names) else f"{p}_{q}").alias("value")) for p, q in pairs])
    return wide.select(*by, F.col("n").alias("n_obs"), F.inline(entries))


def margins(design: DataFrame, names: Sequence[str], by: Sequence[str] = ("t",)) -> DataFrame:
    """(by, side, actor, name, value): row and column sums of each covariate."""
    by, out = list(by), None
    for at, side in (("i", "row"), ("j", "col")):
        sums = design.groupBy(*by, F.col(at).alias("actor")).agg(*[F.sum(n).alias(n) for n in names]).withColumn("side", F.lit(side))
        long = sums.unpivot([*by, "side", "actor"], list(names), "name", "value")
        out = long if out is None else out.unionByName(long)
    return out


def linear_predictor(design: DataFrame, beta: dict[str, float], name: str = "eta") -> DataFrame:
    """The sum of beta times covariate; 0 without coefficients."""
    total = F.lit(0.0)
    for k, b in beta.items():
        total = total + F.lit(float(b)) * F.col(k)
    return design.withColumn(name, total)


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Ranks with ties at their mean; nulls have none and count for none."""
    seen = F.col(value).isNotNull()
    order = Window.partitionBy(*by, seen).orderBy(value)
    ties = Window.partitionBy(*by, seen, value)
    return F.when(seen, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0)


def normal_quantile(p: Column) -> Column:
    """The inverse normal distribution function as plain arithmetic (Acklam's rational approximation, relative error below 1.2e-9)."""
    # fixed values of the approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
    low = 0.02425

    def horner(values: tuple[float, ...], x: Column) -> Column:
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * x + F.lit(v)
        return out

    tail = lambda q: horner(c, q) / (horner(d, q) * q + 1.0)
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    middle = horner(a, r) * q / (horner(b, r) * r + 1.0)
    return F.when((p <= 0) | (p >= 1), None).when(p < low, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - low, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def normal_scores(dyads: DataFrame, value: str = "y", by: Sequence[str] = (), name: str = "z") -> DataFrame:
    """Normal quantiles of average rank / (1 + number observed); null stays null."""
    score = lambda rank, n: normal_quantile(rank / (1.0 + n))
    if by:
        ranked = dyads.withColumn("_rank", average_rank(value, by)).withColumn("_n", F.count(value).over(Window.partitionBy(*by)))
        return ranked.withColumn(name, score(F.col("_rank"), F.col("_n"))).drop("_rank", "_n")
    counts = running_sums(dyads.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_c")), "_value", ["_c"])
    total = dyads.agg(F.count(value).alias("_n"))
    scores = counts.crossJoin(F.broadcast(total)).select("_value", score(F.col("_c_upto") - (F.col("_c") - 1) / 2.0, F.col("_n")).alias(name))
    return dyads.drop(name).join(scores, F.col(value) == F.col("_value"), "left").drop("_value")


def working_response(dyads: DataFrame, family: str, by: Sequence[str] = ("t",)) -> DataFrame:
    """z: y for normal, log(y + 1) for poisson, and for binary normal scores per period, shifted so that zeros and ones part at zero."""
    by = list(by)
    if family == "normal":
        return dyads.withColumn("z", F.col("y").cast("double"))
    if family == "poisson":
        return dyads.withColumn("z", F.log1p("y"))
    if family != "binary":
        raise ValueError("the family is normal, binary or poisson")
    scored = normal_scores(dyads, "y", by)
    group = Window.partitionBy(*by)
    top, bottom = F.max(F.when(F.col("y") == 0, F.col("z"))).over(group), F.min(F.when(F.col("y") == 1, F.col("z"))).over(group)
    return scored.withColumn("z", F.col("z") - F.coalesce((top + bottom) / 2, F.lit(0.0)))


def start_values(dyads: DataFrame, family: str, by: Sequence[str] = ("t",)) -> DataFrame:
    """z for a sampler: the family's working value, and for unobserved cells the mean plus row and column mean."""
    by = list(by)
    if family in ("normal",):
        scored = dyads.withColumn("z", F.col("y").cast("double"))
    elif family == "poisson":
        scored = dyads.withColumn("z", F.log1p("y"))
    else:
        scored = normal_scores(dyads, "y", by)
        if family in ("binary", "cbin", "frn"):
            group = Window.partitionBy(*by)
            top, bottom = F.max(F.when(F.col("y") == 0, F.col("z"))).over(group), F.min(F.when(F.col("y") > 0, F.col("z"))).over(group)
            scored = scored.withColumn("z", F.col("z") - F.coalesce((top + bottom) / 2, F.lit(0.0)))
    mean = lambda *k: F.avg("z").over(Window.partitionBy(*by, *k))
    fill = F.coalesce(mean(), F.lit(0.0)) + F.coalesce(mean("i"), F.lit(0.0)) + F.coalesce(mean("j"), F.lit(0.0))
    return scored.withColumn("z", F.coalesce("z", fill))
