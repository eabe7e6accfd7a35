"""Likelihoods of rankings under normal scores, by folds over quasi-random nodes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.functions.distributions import log_normal_cdf, primes, radical_inverse
from relata.operators.design import normal_quantile
from relata.operators.summaries import fold, let

#: Points that are left out at the beginning of each sequence, which are the most alike between bases.
BURN = 30


def node_table(spark, nodes: int, depth: int) -> DataFrame:
    """(node, u): a point in the unit cube of `depth` dimensions for each node, one prime base a dimension."""
    bases = list(islice(primes(), depth))
    k = F.col("id") + BURN + 1
    inside = lambda u: F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12))
    return spark.range(nodes).select(F.col("id").alias("node"), F.array(*[inside(radical_inverse(k, b)) for b in bases]).alias("u"))


def rank_log_probability(ranked: DataFrame, key: Sequence[str], nodes: int = 64) -> DataFrame:
    """(key, log_probability) that scores z, normal with variance 1 around their means, fall in an order.

    ranked has for each key the means `e` of the ranked items from the strongest on, and those of the others, `f`,
    all below the last ranked one. Items are drawn from the top, each below the one before, and the
    chances of doing so are multiplied along a fold; a node of a low-discrepancy table gives the draws of one such
    pass. Every key meets every node, rows of one number each, and their mean is one aggregation.
    Keys without a ranked item have probability 1.
    """
    key = list(key)
    depth = max(1, ranked.agg(F.max(F.size("e"))).first()[0] or 1)
    each = ranked.crossJoin(F.broadcast(node_table(ranked.sparkSession, nodes, depth)))  # `nodes` rows of `depth` numbers
    items = F.zip_with("e", F.slice("u", F.lit(1), F.greatest(F.size("e"), F.lit(1))), lambda eta, u: F.struct(eta.cast("double").alias("eta"), u.alias("u")))

    def step(state: Column, x: Column) -> Column:
        def after(log_p: Column) -> Column:
            p = F.least(F.greatest(x["u"] * F.exp(log_p), F.lit(1e-300)), F.lit(1 - 1e-16))
            z = x["eta"] + normal_quantile(p)
            return F.struct((state["weight"] + log_p).alias("weight"), F.least(z, state["above"]).alias("above"))

        below = F.when(state["above"].isNull(), 0.0).otherwise(log_normal_cdf(state["above"] - x["eta"]))
        return F.when(x["eta"].isNull(), state).otherwise(let(below, after))

    begin = F.struct(F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("above"))
    free = lambda above: F.when(above.isNull(), 0.0).otherwise(fold(F.col("f"), lambda eta: log_normal_cdf(above - eta)))
    weight = F.aggregate(items, begin, step, lambda state: state["weight"] + free(state["above"]))
    many = each.select(*key, weight.alias("w")).groupBy(*key).agg(F.collect_list("w").alias("w"))
    return many.select(*key, let(F.array_max("w"), lambda top: F.log(fold(F.col("w"), lambda w: F.exp(w - top)) / F.size("w")) + top).alias("log_probability"))
