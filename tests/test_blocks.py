"""The block fit against dense alternating least squares, its layout, and reweighted families against Newton's method."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.functions import links
from relata.plans import blocks


def uniform(seed, k, actor):
    return int(hashlib.md5(f"{seed}:{k}:{actor}".encode()).hexdigest()[:8], 16) / 2**31 - 1


def simulated(n=14, m=9, seen=0.8, seed=3, family="normal"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, m))
    eta = 0.2 + 0.6 * x + rng.normal(0, 0.6, n)[:, None] + rng.normal(0, 0.6, m)[None] + rng.normal(size=(n, 2)) @ rng.normal(size=(2, m)) * 0.5
    y = {"normal": lambda: eta + rng.normal(0, 0.3, (n, m)), "poisson": lambda: rng.poisson(np.exp(eta)).astype(float), "binary": lambda: (rng.random((n, m)) < 1 / (1 + np.exp(-eta))).astype(float)}[family]()
    y[rng.random((n, m)) > seen] = np.nan
    return x, y


def table(spark, x, y, weight=None):
    rows = [(f"r{i}", f"c{j}", None if np.isnan(y[i, j]) else float(y[i, j]), 1.0, float(x[i, j]), float(weight[i, j]) if weight is not None else 1.0) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "i string, j string, y double, intercept double, x double, w double")


class Dense:
    """The same steps on whole matrices."""

    def __init__(self, x, y, rank, ridge, w=None, seed=29):
        self.x, self.seen, self.rank, self.ridge = x, ~np.isnan(y), rank, ridge
        self.z, self.w = np.nan_to_num(y), np.where(self.seen, 1.0 if w is None else w, 0.0)
        n, m = y.shape
        self.p = [np.zeros((n, rank + 1)), np.array([[0.0, *[uniform(seed, k, f"c{j}") for k in range(rank)]] for j in range(m)])]
        self.beta = np.zeros(2)

    def base(self):
        a, b = self.p
        return a[:, :1] + b[:, 0][None] + a[:, 1:] @ b[:, 1:].T

    def eta(self):
        return self.base() + self.beta[0] + self.beta[1] * self.x

    def coefficients(self):
        d = np.stack([np.ones_like(self.x), self.x], -1).reshape(-1, 2) * np.sqrt(self.w).reshape(-1, 1)
        self.beta = np.linalg.lstsq(d, ((self.z - self.base()) * np.sqrt(self.w)).ravel(), rcond=None)[0]

    def sweep(self):
        for s in (0, 1):
            other = self.p[1 - s]
            e = self.z - self.beta[0] - self.beta[1] * self.x
            e, w = (e, self.w) if s == 0 else (e.T, self.w.T)
            for k in range(len(self.p[s])):
                c = np.column_stack([np.ones(len(other)), other[:, 1:]])
                a = (c * w[k][:, None]).T @ c + np.diag([0.0, *[self.ridge] * self.rank])
                self.p[s][k] = np.linalg.solve(a, (c * w[k][:, None]).T @ (e[k] - other[:, 0]))
            self.p[s][:, 0] -= self.p[s][:, 0].mean()
        self.coefficients()

    def objective(self):
        return (self.w * (self.z - self.eta()) ** 2).sum() + self.ridge * sum((q[:, 1:] ** 2).sum() for q in self.p)


def fitted_matrix(fit, spark, x):
    got = fit.predict(table(spark, x, np.zeros_like(x))).select("i", "j", "eta").collect()
    out = np.zeros_like(x)
    for r in got:
        out[int(r.i[1:]), int(r.j[1:])] = r.eta
    return out


@pytest.mark.parametrize("rank,weighted", [(0, False), (2, True)])
def test_every_sweep_equals_the_dense_one(spark, rank, weighted):
    x, y = simulated()
    w = np.random.default_rng(1).uniform(0.2, 2, x.shape) if weighted else None
    fit = blocks.block_fit(table(spark, x, y, w), ["intercept", "x"], rank, weight="w" if weighted else None, ridge=0.1, sweeps=2, tol=0.0, tile_cells=20, block_actors=5)
    dense = Dense(x, y, rank, 0.1, w)
    dense.coefficients()
    for _ in range(2):
        dense.sweep()
    assert fit.sweeps == 2 and not fit.converged
    assert np.allclose(fitted_matrix(fit, spark, x), dense.eta(), atol=1e-8)
    assert np.isclose(fit.objective, dense.objective()) and np.allclose(list(fit.beta.values()), dense.beta)
    effects = {r.actor: r.effect for r in fit.rows.collect()}
    assert np.allclose([effects[f"r{i}"] for i in range(len(x))], dense.p[0][:, 0])
    if rank:
        u = np.array([r.position for r in fit.rows.collect()])
        v = np.array([r.position for r in fit.columns.collect()])
        assert np.allclose(u.T @ u, v.T @ v) and np.allclose(u.T @ u, np.diag(np.diag(u.T @ u)), atol=1e-8)


def test_converged_fit_without_factors_is_least_squares(spark):
    x, y = simulated(seen=1.0)
    fit = blocks.block_fit(table(spark, x, y), ["intercept", "x"], sweeps=20, tol=1e-9)
    i, j = np.nonzero(~np.isnan(y))
    design = np.zeros((len(i), 2 + sum(x.shape)))
    design[:, 0], design[:, 1] = 1, x[i, j]
    design[np.arange(len(i)), 2 + i] = design[np.arange(len(i)), 2 + len(x) + j] = 1
    fitted = design @ np.linalg.lstsq(design, y[i, j], rcond=None)[0]
    assert fit.converged and np.isclose(fit.objective, ((y[i, j] - fitted) ** 2).sum(), rtol=1e-6)
    left = fit.residuals(table(spark, x, y)).where("residual is not null").agg(F.sum(F.pow("residual", 2))).first()[0]
    assert np.isclose(left, fit.objective)


@pytest.mark.parametrize("family,rank", [("poisson", 1), ("binary", 0)])
def test_reweighted_steps_equal_the_dense_ones(spark, family, rank):
    x, y = simulated(12, 9, 0.9, 8, family)
    fit = blocks.block_fit(table(spark, x, y), ["intercept", "x"], rank, family, ridge=1.0, sweeps=2, tol=0.0, outer=2)
    dense, seen, mean = Dense(x, y, rank, 1.0), ~np.isnan(y), np.nanmean(y)
    dense.beta = np.array([np.log(mean) if family == "poisson" else np.log(mean / (1 - mean)), 0.0])
    trace = [links.deviance(y, dense.eta(), family, "logit")]
    half_way = (np.nan_to_num(y) + mean) / 2
    for eta in (np.log(half_way) if family == "poisson" else np.log(half_way / (1 - half_way)), None):
        z, w = links.working_response(np.nan_to_num(y), dense.eta() if eta is None else eta, family, "logit")
        dense.z, dense.w = np.where(seen, z, 0), np.where(seen, w, 0)
        dense.sweep()
        dense.sweep()
        trace.append(links.deviance(y, dense.eta(), family, "logit") + sum((q[:, 1:] ** 2).sum() for q in dense.p))
    assert trace == sorted(trace, reverse=True) and np.allclose(fit.trace, trace)
    assert np.allclose(fitted_matrix(fit, spark, x), dense.eta(), atol=1e-7)


def test_factors_of_counts_lower_the_penalised_deviance(spark):
    x, y = simulated(20, 16, 0.9, 5, "poisson")
    cells = table(spark, x, y)
    without = blocks.block_fit(cells, ["intercept", "x"], family="poisson", sweeps=1, outer=2)
    fit = blocks.block_fit(cells, ["intercept", "x"], 1, "poisson", ridge="empirical", sweeps=1, outer=2)
    eta = fitted_matrix(fit, spark, x)
    assert links.deviance(y, np.where(np.isnan(y), np.nan, eta), "poisson") < without.objective


def test_an_overshooting_step_is_halved(spark):
    """Counts of zero beside one of 10^6: a full step from the mean raises the deviance, and the kept iterates never do."""
    y = np.zeros((6, 6))
    y[0, 0] = 1e6
    fit = blocks.block_fit(table(spark, np.zeros_like(y), y), ["intercept"], family="poisson", sweeps=1, outer=2)
    assert fit.trace == sorted(fit.trace, reverse=True) and len(fit.trace) > 1 and np.isfinite(fit.objective)


def test_layout(spark):
    """A sender with a third of all cells is spread over tiles, large tiles are cut, and sweeps leave cells where they are."""
    cells = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 101)).alias("i"), F.concat(F.lit("c"), F.col("id")).alias("j"), F.rand(1).alias("y"), F.lit(1.0).alias("intercept"))
    tiles = blocks.lay_out(cells, ["y", "intercept"], 100, 200)
    assert tiles.cells.count() == 3000
    hot = tiles.cells.where("i = 'hot'").groupBy("tile").count().collect()
    assert len(hot) > 10 and max(r["count"] for r in hot) < 200
    routed = tiles.columns.groupBy("tile").agg(F.count("*").alias("n"), F.max("l").alias("l")).collect()
    assert all(r.l == r.n - 1 for r in routed)
    one = spark.range(2000).select(F.lit("a").alias("i"), F.lit("b").alias("j"), F.rand(2).alias("y"))
    cut = blocks.lay_out(one, ["y"], 100)
    assert cut.cells.groupBy("tile").count().agg(F.max("count")).first()[0] < 400 and cut.cells.count() == 2000
    state = blocks.State(np.zeros(1), blocks.start(tiles.actors("rows"), 1, 1, True), blocks.start(tiles.actors("columns"), 1, 1, False))
    plan = blocks.with_eta(tiles, state, ["intercept"], 1)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan" in line and "Bucketed: true" in line]
    above = plan[: plan.index(scan[0])].split("\n")[-6:]
    assert len(scan) == 1 and not any("Exchange" in line for line in above), plan


def test_no_join_hands_on_the_array_of_a_tile(spark):
    """Cells that pass from one join to the next carry their own numbers; with a tile's array each would be as large as the block."""
    x, y = simulated()
    tiles = blocks.lay_out(table(spark, x, y), ["y", "intercept", "x"], 20, 5)
    state = blocks.State(np.zeros(2), blocks.start(tiles.actors("rows"), 1, 1, True), blocks.start(tiles.actors("columns"), 1, 1, False))
    plan = blocks.with_eta(tiles, state, ["intercept", "x"], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Project \[(?:[^\n]*, )?(?:near|far)#\d+[,\]]", plan), plan


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "i string, j string, y double, intercept double, x double")
    fit = blocks.block_fit(empty, ["intercept", "x"], 1, sweeps=2)
    assert fit.rows.count() == 0 and fit.beta == {"intercept": 0.0, "x": 0.0}
    lone = spark.createDataFrame([("a", "b", 2.0, 1.0), ("a", "b", 2.0, 1.0), ("a", None, 1.0, 1.0), ("c", "b", None, 1.0)], "i string, j string, y double, intercept double")
    fit = blocks.block_fit(lone.where("j is not null"), ["intercept"], 1)
    assert [r.actor for r in fit.rows.collect()] == ["a"] and abs(fit.beta["intercept"] - 2) < 1e-9
    assert [r.eta for r in fit.predict(lone.where("i = 'c'")).collect()] == [2.0]
    with pytest.raises(ValueError):
        blocks.block_fit(lone, ["intercept"], 1, ridge=0.0)
    with pytest.raises(ValueError):
        blocks.block_fit(lone, ["intercept"], family="gamma")


@pytest.mark.parametrize("family,link", [("poisson", None), ("binary", "logit"), ("binary", "probit")])
def test_links_by_their_definition(spark, family, link):
    """Weight and score against derivatives of the deviance; no overflow in the tails."""
    eta, y = np.linspace(-4, 4, 41), np.tile([0.0, 1.0], 21)[:41]
    w, s = links.weight_and_score(y, eta, family, link)
    h = 1e-5
    each = np.array([[links.deviance(np.array([a]), np.array([b + d]), family, link) for d in (-h, h)] for a, b in zip(y, eta)])
    assert np.allclose(-(each[:, 1] - each[:, 0]) / (4 * h), s, atol=1e-4) and (w > 0).all()
    far = links.weight_and_score(np.array([1.0, 0.0]), np.array([-30.0, 30.0]), family, link)
    if family == "binary":
        assert np.isfinite(far).all() and (far[0] >= 0).all()
    if link != "probit":
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, eta)], "y double, e double")
        a, b = links.weight_and_score_columns(F.col("y"), F.col("e"), family)
        got = np.array([(r[0], r[1]) for r in df.select(a, b).collect()])
        assert np.allclose(got[:, 0], w) and np.allclose(got[:, 1], s)
        total = df.select(links.deviance_column(F.col("y"), F.col("e"), family).alias("d")).agg(F.sum("d")).first()[0]
        assert np.isclose(total, links.deviance(y, eta, family, link))
