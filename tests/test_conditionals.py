"""Conditional parameters against dense linear algebra and against the sampler's own steps, and cases with defined results."""

import numpy as np
import pytest

from relata.operators import conditionals as c
from relata.plans import gibbs

CELLS = "t int, i string, j string, e double"


def cells(spark, n=6, periods=4, seed=1):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=(n, n, periods))
    rows = [(t, f"a{i}", f"a{j}", None if i == j else float(e[i, j, t])) for i in range(n) for j in range(n) for t in range(periods)]
    return e, spark.createDataFrame(rows, CELLS)


def test_paths_are_the_means_of_the_joint_normal(spark):
    e, frame = cells(spark)
    n, periods = e.shape[0], e.shape[2]
    got = {(r.i, r.t): r.smoothed for r in c.filtered_paths(frame, ["i"], 0.8, 0.5, 0.7).collect()}
    prior = gibbs.ar1_precision(periods, 0.8, 0.5)
    for i in range(n):
        sums = np.array([e[i, [j for j in range(n) if j != i], t].sum() for t in range(periods)])
        mean = np.linalg.solve(prior + np.eye(periods) * (n - 1) / 0.7, sums / 0.7)
        assert [got[(f"a{i}", t)] for t in range(periods)] == pytest.approx(mean.tolist())


def test_a_period_without_values_is_unobserved(spark):
    frame = spark.createDataFrame([(0, "a", "b", 1.0), (1, "a", "b", None), (2, "a", "b", 1.0)], CELLS)
    rows = {r.t: r for r in c.filtered_paths(frame, ["i"], 0.5, 1.0, 1.0).collect()}
    assert rows[1].filtered == pytest.approx(0.5 * rows[0].filtered) and rows[1].smoothed > rows[1].filtered and rows[1].variance > rows[0].variance
    assert c.filtered_paths(frame.limit(0), ["i"], 0.5, 1.0, 1.0).count() == 0


def test_factors_and_coefficients_are_ridge_solutions(spark):
    e, frame = cells(spark, periods=1)
    v = np.random.default_rng(2).normal(size=(6, 2))
    positions = spark.createDataFrame([(f"a{k}", [float(x) for x in v[k]]) for k in range(6)], "actor string, u array<double>")
    got = {r.i: (r.mean_1, r.mean_2) for r in c.factors(frame, positions, 0.7).collect()}
    for i in range(6):
        other = [j for j in range(6) if j != i]
        want = np.linalg.solve(np.eye(2) + v[other].T @ v[other] / 0.7, v[other].T @ e[i, other, 0] / 0.7)
        assert got[f"a{i}"] == pytest.approx(tuple(want))


def test_bounds_hold_the_sampler_to_the_data(spark):
    """Every latent response that agrees with the data lies within its bounds."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(5, 8))
    rows = []
    for i in range(5):
        order = np.argsort(-z[i])
        named = [j for j in order if z[i, j] > 0][:3]
        rows += [(0, f"a{i}", f"b{j}", float(3 - named.index(j)) if j in named else 0.0, float(z[i, j])) for j in range(8)]
    frame = spark.createDataFrame(rows, "t int, i string, j string, y double, z double")
    for bounded in (c.ranked_bounds(frame, 3), c.censored_bounds(frame, 3)):
        out = bounded.collect()
        assert len(out) == 40 and all((r.low is None or r.low <= r.z) and (r.high is None or r.z <= r.high) for r in out)
    levels = {r.y: (r.low, r.high) for r in c.ordinal_bounds(frame.withColumn("z", frame["y"] + 0.0)).collect()}
    assert levels[0.0] == (None, 1.0) and levels[3.0] == (2.0, None)


def test_symmetric_moving_effects_have_the_joint_posterior(spark):
    """With everything else fixed, the mean level of the effects is as variable as the joint normal says."""
    n, periods, s2, rho, sig = 10, 3, 1.0, 0.8, 0.5
    chain = object.__new__(gibbs.Chain)
    chain.o = type("O", (), {"time_index": None, "row_effects": True, "col_effects": True, "symmetric": True})()
    chain.n = chain.m = n
    chain.T, chain.s2, chain.rho_ab, chain.sig_ab, chain.square = periods, s2, rho, sig, True
    chain.off = ~np.eye(n, dtype=bool)
    chain.rng = np.random.default_rng(5)
    noise = np.random.default_rng(6).normal(size=(n, n, periods))
    e = (noise + noise.transpose(1, 0, 2)) / 2
    chain.a, chain.b = np.zeros((n, periods)), np.zeros((n, periods))
    levels = []
    for _ in range(1500):
        chain._draw_additive_paths(e, gibbs.ar1_precision(periods, rho, sig))
        assert np.array_equal(chain.a, chain.b)
        levels.append(chain.a[:, 0].mean())
    levels = np.array(levels[100:])
    prior = gibbs.ar1_precision(periods, rho, sig)
    joint = np.kron(np.eye(n), prior) + np.kron(np.eye(n) * (n - 1) + (np.ones((n, n)) - np.eye(n)), np.eye(periods)) / s2
    weights = np.kron(np.ones(n) / n, np.eye(periods)[0])
    sums = (e * chain.off[:, :, None]).sum(1).ravel() / s2
    mean, sd = weights @ np.linalg.solve(joint, sums), np.sqrt(weights @ np.linalg.solve(joint, weights))
    assert abs(levels.mean() - mean) < 0.15 * sd + 0.02 and 0.8 * sd < levels.std() < 1.25 * sd
