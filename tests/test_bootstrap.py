"""The one-pass bootstrap against a refit of every replicate with the same weights."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.operators import bootstrap as b
from relata.plans.blocks import block_fit


def uniform(*keys):
    return (int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def data(n=60, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(k % 6), f"r{k % 11}", f"c{k % 7}", float(0.5 + 2 * x + e), 1.0, float(x)) for k, (x, e) in enumerate(rng.normal(size=(n, 2)))]


SCHEMA = "t int, i string, j string, y double, intercept double, x double"


@pytest.mark.parametrize("scheme", ["exponential", "poisson"])
@pytest.mark.parametrize("block", [("t",), ("i", "j")])
def test_equals_refits(spark, scheme, block):
    rows = data()
    got = {(r.replicate, r.term): r.value for r in b.bootstrap_draws(spark.createDataFrame([*rows, (9, "r1", None, None, 1.0, 1.0)], SCHEMA), ["intercept", "x"], 15, block, scheme=scheme, seed=5).collect()}
    assert len(got) == 30
    x, y = np.array([r[4:] for r in rows]), np.array([r[3] for r in rows])
    for k in range(1, 16):
        u = np.array([uniform(5, *([r[0]] if block == ("t",) else r[1:3]), k) for r in rows])
        steps = np.cumsum([np.exp(-1) / np.prod(np.arange(1, m + 1)) for m in range(12)])
        w = -np.log(u) if scheme == "exponential" else (u[:, None] > steps).sum(1)
        want = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        assert np.allclose([got[k, "intercept"], got[k, "x"]], want)


def test_intervals_and_defined_cases(spark):
    draws = spark.createDataFrame([(k, "x", float(k)) for k in range(1, 101)], "replicate int, term string, value double")
    one = b.bootstrap_intervals(draws, 0.9).first()
    assert (one.mean, round(one.low, 6), round(one.high, 6)) == (50.5, 5.95, 95.05)
    empty = spark.createDataFrame([], SCHEMA)
    assert b.bootstrap_draws(empty, ["intercept", "x"], 3).count() == 0
    same = spark.createDataFrame([(1, "a", "b", 2.0, 1.0, 1.0)], SCHEMA)  # a deficient design has the least norm
    assert all(abs(r.value - 1) < 1e-9 for r in b.bootstrap_draws(same, ["intercept", "x"], 3).collect())
    with pytest.raises(ValueError):
        b.block_weight("other", F.lit(0.5))


def test_plan_reads_the_cells_once(spark):
    cells = spark.createDataFrame(data(), SCHEMA)
    plan = b.bootstrap_draws(cells, ["intercept", "x"], 200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and plan.count("Join") == 0 and plan.count("Exchange hashpartitioning") == 2


def test_of_a_block_fit(spark):
    """Given effects and factors, replicates spread around the fit's coefficients; other families take a weighted step."""
    cells = spark.createDataFrame(data(80, 3), SCHEMA)
    fit = block_fit(cells, ["intercept", "x"], sweeps=3)
    out = {r.term: r for r in b.bootstrap_intervals(fit.bootstrap(cells, 100)).collect()}
    assert out["x"].low < fit.beta["x"] < out["x"].high and 0 < out["x"].std_error < 0.5
    counts = cells.withColumn("y", F.floor(F.exp(F.least("x", F.lit(2.0)))).cast("double"))
    fit = block_fit(counts, ["intercept", "x"], family="poisson", sweeps=1, outer=2)
    out = {r.term: r for r in b.bootstrap_intervals(fit.bootstrap(counts, 50, ("t",), "poisson")).collect()}
    assert out["x"].low < out["x"].mean < out["x"].high
