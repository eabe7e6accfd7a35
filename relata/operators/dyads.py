"""Cell and pair arithmetic of the models as column expressions: densities, working responses, surfaces, gauges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.operators.statistics import transposed

LOG_2PI = 1.8378770664093453


def pair_log_density(cells: DataFrame, rho: float, s2: float, family: str = "normal", by: Sequence[str] = ("t",), exposure: Column | None = None) -> DataFrame:
    """(by, i, j, log_density) for i < j: the joint normal of z and its opposite around eta, plus the Poisson terms of y given z.

    cells has z, eta and, for poisson, y. A pair of which one half is missing has a null density on both sides.
    """
    e = cells.withColumn("e", F.col("z") - F.col("eta"))
    both = transposed(e, "e_back", "e", by)
    if family == "poisson":
        both = transposed(transposed(both, "y_back", "y", by), "z_back", "z", by)
    pairs = both.where("i < j")
    quad = (F.col("e") * F.col("e") + F.col("e_back") * F.col("e_back") - 2 * rho * F.col("e") * F.col("e_back")) / (s2 * (1 - rho * rho))
    density = -LOG_2PI - F.log(F.lit(s2)) - 0.5 * F.log(F.lit(1 - rho * rho)) - quad / 2
    if family == "poisson":
        from relata.operators.evaluation import log_factorial

        shift = F.log(exposure) if exposure is not None else F.lit(0.0)
        count = lambda y, z: F.col(y) * (F.col(z) + shift) - F.exp(F.col(z) + shift) - log_factorial(F.col(y))
        density = density + count("y", "z") + count("y_back", "z_back")
    return pairs.select(*by, "i", "j", density.alias("log_density"))


def reciprocity_profile(cells: DataFrame, rhos: Sequence[float], s2: float = 1.0, by: Sequence[str] = ("t",)) -> DataFrame:
    """(by, rho, log_likelihood) of residuals `e` on a grid; three sums per network, then arithmetic."""
    pairs = transposed(cells, "e_back", "e", by).where("i < j and e is not null and e_back is not null")
    x, y = F.col("e"), F.col("e_back")
    sums = pairs.groupBy(*by).agg(F.sum(x * x + y * y).alias("s"), F.sum(x * y).alias("c"), F.count("*").alias("n"))
    grid = sums.withColumn("rho", F.explode(F.array(*[F.lit(float(r)) for r in rhos])))
    r = F.col("rho")
    value = -F.col("n") * (LOG_2PI + float(np.log(s2))) - 0.5 * F.col("n") * F.log(1 - r * r) - (F.col("s") - 2 * r * F.col("c")) / (2 * s2 * (1 - r * r))
    return grid.select(*by, "rho", value.alias("log_likelihood"))


def poisson_deviance(y: Column, mu: Column) -> Column:
    """An aggregate: twice the log ratio to the saturated fit."""
    return 2 * F.sum(F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))


def binary_deviance(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -2 * F.sum(y * F.log(q) + (1 - y) * F.log(1 - q))


def dot(u: str, v: str) -> Column:
    """The product of two array columns."""
    return F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def product_surface(rows: DataFrame, columns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, j, value): u' v of all pairs of positions (by, actor, u array), as large as the surface itself."""
    a = rows.select(*by, F.col("actor").alias("i"), F.col("u").alias("a"))
    b = columns.select(*by, F.col("actor").alias("j"), F.col("u").alias("b"))
    pairs = a.join(b, list(by)) if by else a.crossJoin(b)
    return pairs.select(*by, "i", "j", dot("a", "b").alias("value"))


def cross_product(a: DataFrame, b: DataFrame, key: Sequence[str] = ("actor",)) -> DataFrame:
    """(r, s, value) of A'B over matching actors: what a rotation of one set of positions onto another is computed from."""
    both = a.select(*key, F.col("u").alias("a")).join(b.select(*key, F.col("u").alias("b")), list(key))
    left = both.select("b", F.posexplode("a").alias("r", "x"))
    long = left.select("r", "x", F.posexplode("b").alias("s", "y"))
    return long.groupBy("r", "s").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("value"))


def rotation(a: DataFrame, b: DataFrame, rank: int, key: Sequence[str] = ("actor",)) -> np.ndarray:
    """The orthogonal matrix that brings positions a nearest to b; the driver gets rank x rank numbers."""
    m = np.zeros((rank, rank))
    for r in cross_product(a, b, key).collect():
        m[r["r"], r["s"]] = r["value"]
    u, _, v = np.linalg.svd(m)
    return u @ v


def rotated(positions: DataFrame, q: np.ndarray) -> DataFrame:
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in column]) for column in q.T])
    return positions.withColumn("u", F.transform(rows, lambda c: F.aggregate(F.zip_with("u", c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def aligned_over_time(positions: DataFrame, rank: int) -> DataFrame:
    """Positions (t, actor, u), each period rotated onto the one before as it was rotated.

    One plan for any number of periods: the products of all pairs of neighbouring periods come from one
    aggregation, rank^2 numbers a pair; the rotations follow from them in order, in one task that gets
    these numbers alone, and are joined back to the positions.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("t")
    periods = positions.select("t").distinct().select("t", F.lag("t").over(order).alias("before"))
    old = positions.select(F.col("t").alias("before"), "actor", F.col("u").alias("b"))
    pairs = positions.join(periods, "t").join(old, ["before", "actor"])
    cells = [F.sum(F.get("u", F.lit(r)).cast("double") * F.get("b", F.lit(s)).cast("double")).alias(f"m{r}_{s}") for r in range(rank) for s in range(rank)]
    products = periods.join(pairs.groupBy("t").agg(*cells), "t", "left")
    kind = positions.schema["t"].dataType.simpleString()

    def turns(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, turn, out = pdf.sort_values("t"), np.eye(rank), []
        m = pdf[[f"m{r}_{s}" for r in range(rank) for s in range(rank)]].fillna(0.0).to_numpy(float).reshape(-1, rank, rank)
        for k in range(len(pdf)):
            if k:
                u, _, v = np.linalg.svd(m[k] @ turn)
                turn = u @ v
            out.append(turn.T.tolist())
        return pd.DataFrame({"t": pdf["t"], "turn": out})

    turned = products.drop("before").groupBy().applyInPandas(turns, f"t {kind}, turn array<array<double>>")
    along = F.transform("turn", lambda c: F.aggregate(F.zip_with("u", c, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x))
    return positions.join(turned, "t").withColumn("u", along).drop("turn").select(positions.columns)


def centred_products(surface: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, j, value, row, col, mean): the surface without its margins, which belong to the additive terms."""
    w = lambda *k: F.avg("value").over(Window.partitionBy(*by, *k))
    full = surface.withColumn("mean", w()) if by else surface.crossJoin(F.broadcast(surface.agg(F.avg("value").alias("mean"))))
    full = full.withColumn("row", w("i") - F.col("mean")).withColumn("col", w("j") - F.col("mean"))
    return full.select(*by, "i", "j", (F.col("value") - F.col("mean") - F.col("row") - F.col("col")).alias("value"), "row", "col", "mean")


def component_gauge(effects: DataFrame, components: DataFrame) -> DataFrame:
    """Effects (actor, side, effect) shifted so that row effects have mean zero in each component (actor, side, root); fits stay as they are."""
    joined = effects.join(components, ["actor", "side"])
    mean = F.avg(F.when(F.col("side") == "row", F.col("effect"))).over(Window.partitionBy("root"))
    shift = F.coalesce(mean, F.lit(0.0))
    return joined.select("actor", "side", "root", F.when(F.col("side") == "row", F.col("effect") - shift).otherwise(F.col("effect") + shift).alias("effect"))


def transitions(paths: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Adjacent pairs (key, t, value, before) of paths; gaps in t are no transitions."""
    w = Window.partitionBy(*key).orderBy("t")
    out = paths.withColumn("before", F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag(value).over(w)))
    return out.where("before is not null").select(*key, "t", value, "before")


def autoregression(paths: DataFrame, key: Sequence[str], value: str = "value") -> float:
    """Sum of products of neighbours over the sum of squares of the earlier ones."""
    r = transitions(paths, key, value).agg(F.try_divide(F.sum(F.col(value) * F.col("before")), F.sum(F.col("before") * F.col("before")))).first()[0]
    return float(r or 0.0)


def nominations(scores: DataFrame, most: int, by: Sequence[str] = ("t",), value: str = "z") -> DataFrame:
    """Fixed rank nominations of latent scores: each sender's up to `most` positive ones, the strongest with the largest number."""
    w = Window.partitionBy(*by, "i").orderBy(F.desc(value), "j")
    ranked = scores.withColumn("_k", F.when(F.col(value).isNotNull(), F.row_number().over(w)))
    tie = (F.col("_k") <= most) & (F.col(value) > 0)
    total = F.sum(tie.cast("int")).over(Window.partitionBy(*by, "i"))
    return ranked.withColumn("y", F.when(F.col(value).isNull(), None).when(tie, (total - F.col("_k") + 1).cast("double")).otherwise(0.0)).drop("_k")


def ordinal_cuts(scores: DataFrame, shares: Sequence[float], value: str = "z", by: Sequence[str] = ("t",)) -> DataFrame:
    """Levels 0, 1, ... of latent scores cut at quantiles of the cumulative shares."""
    q = scores.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(s)) for s in shares])).alias("_cuts"))
    return scores.join(q, list(by)).withColumn("y", F.size(F.filter("_cuts", lambda c: c < F.col(value))).cast("double")).drop("_cuts")
