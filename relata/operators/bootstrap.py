"""Bootstraps of coefficients from cross products: no replicate reads the panel again.

Cells are summed to the cross products of their block (a period, an actor, a pair)
once. A block's weight in a replicate is keyed by the MD5 of seed, block and
replicate, so it is the same in every run and on every machine; all replicates are
weighted sums of the blocks' products, made in one aggregation with partial
sums per task. What is shuffled is one row per block and task, then one per replicate and task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.functions.linear import safe_solve

#: Counts that a Poisson weight of mean 1 can have; the chance of more is below 2^-32.
MOST = 12


def keyed_uniform(*keys: Column) -> Column:
    """A number between 0 and 1, both excluded, from the MD5 of the keys joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 2**32


def block_weight(scheme: str, u: Column) -> Column:
    """exponential: that of the Bayesian bootstrap. poisson: a count of mean 1, as in draws with replacement from many blocks."""
    if scheme == "exponential":
        return -F.log(u)
    if scheme != "poisson":
        raise ValueError("weights are exponential or poisson")
    total, term, count = 0.0, float(np.exp(-1)), F.lit(0)
    for k in range(MOST):
        total += term
        count = count + (u > total).cast("int")
        term /= k + 1
    return count.cast("double")


def block_products(design: DataFrame, names: Sequence[str], block: Sequence[str], response: str = "y", weight: Column | None = None) -> DataFrame:
    """(block columns, s0, s1, ...): the upper half of X'WX and then X'Wy of each block's observed cells."""
    names, w = list(names), F.lit(1.0) if weight is None else weight
    terms = [w * F.col(a) * F.col(b) for k, a in enumerate(names) for b in names[k:]] + [w * F.col(a) * F.col(response) for a in names]
    seen = design.where(F.col(response).isNotNull())
    for n in names:
        seen = seen.where(F.col(n).isNotNull())
    return seen.groupBy(*block).agg(*[F.sum(t).alias(f"s{k}") for k, t in enumerate(terms)])


def bootstrap_draws(design: DataFrame, names: Sequence[str], replicates: int = 200, block: Sequence[str] = ("t",), response: str = "y", weight: Column | None = None, scheme: str = "exponential", seed: int = 17) -> DataFrame:
    """(replicate, term, value): weighted least squares of each replicate; minimum norm where its design is deficient."""
    names, p = list(names), len(names)
    products = block_products(design, names, block, response, weight)
    size = p * (p + 1) // 2 + p
    numbered = products.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weighed = numbered.withColumn("_w", block_weight(scheme, keyed_uniform(F.lit(seed), *[F.col(b) for b in block], F.col("replicate"))))
    sums = weighed.groupBy("replicate").agg(*[F.sum(F.col("_w") * F.col(f"s{k}")).alias(f"s{k}") for k in range(size)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(p)
        for batch in batches:
            s = np.stack([batch.column(f"s{k}").to_numpy(zero_copy_only=False) for k in range(size)], 1)
            values = []
            for row in s:
                xx = np.zeros((p, p))
                xx[upper] = row[: len(upper[0])]
                values.append(safe_solve(xx + np.triu(xx, 1).T, row[len(upper[0]) :]))
            replicate = np.repeat(batch.column("replicate").to_numpy(), p)
            yield pa.RecordBatch.from_arrays([pa.array(replicate, pa.int32()), pa.array(names * batch.num_rows), pa.array(np.ravel(values), pa.float64())], names=["replicate", "term", "value"])

    return sums.mapInArrow(solve, "replicate int, term string, value double")


def bootstrap_intervals(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """(term, mean, std_error, low, high): percentile intervals of replicates."""
    tail = (1 - level) / 2
    cut = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    return draws.groupBy("term").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std_error"), cut.alias("q")).select("term", "mean", "std_error", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
