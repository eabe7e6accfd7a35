"""Steps into the future: units, symmetry, absent sides, kinds of paths, and one step shared by forecasts and held-out densities."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from simulated import frame, panel

from relata.plans import gibbs
from relata.plans import models as m
from relata.plans.gibbs import Chain, Options, path_step

SHORT = {"burn": 40, "scan": 60, "thin": 5}


def future(spark, p, options, split):
    return {r.period: r.elpd for r in m.leave_future_out(m.Data.of(frame(spark, p), ["x"]), options, [split]).collect()}[split]


@pytest.mark.parametrize("kind", ["ar1", "rw1"])
def test_densities_do_not_depend_on_the_unit_of_a_covariate(spark, kind):
    p, _ = panel(9, periods=5, seed=21, paths=True)
    options = Options(dynamic_beta=("x_dyad",), beta_kind=kind, **SHORT)
    found = []
    for factor in (1.0, 100.0, 0.01):
        x = p.x.copy()
        x[:, :, 1] *= factor
        found.append(future(spark, gibbs.Panel(p.y, x, p.rows, p.columns, p.periods, p.names, p.square), options, 5))
    assert max(found) - min(found) < 0.05 * abs(found[0])


def test_noise_of_coefficients_is_on_their_own_scale(spark):
    """Draws ahead of a chain spread as its own innovations do, whatever the unit."""
    p, _ = panel(8, periods=4, seed=3, paths=True)
    spread = []
    for factor in (1.0, 50.0):
        x = p.x.copy()
        x[:, :, 1] *= factor
        chain = Chain(gibbs.Panel(p.y, x, p.rows, p.columns, p.periods, p.names, p.square), Options(dynamic_beta=("x_dyad",), **SHORT))
        chain.sig_beta[:] = 0.25
        ahead = np.array([chain.coefficients_ahead()[1] for _ in range(4000)])
        spread.append(ahead.std() * factor)
        assert (np.array([chain.coefficients_ahead()[0] for _ in range(3)]) == chain.beta[0, -1]).all()
    assert np.isclose(spread[0], spread[1], rtol=0.1)


def test_steps_of_each_kind():
    assert path_step("ar1", 0.7) == (0.7, 0.0) and path_step("rw1") == (1.0, 0.0) and path_step("matern32") == (1.0, 0.0)
    assert path_step("rw2") == (2.0, -1.0) and path_step("rw2", periods=2) == (1.0, 0.0)
    # the conditional of the next value under the prior of one more period has these weights
    for kind, rho in (("ar1", 0.7), ("rw1", 1.0), ("rw2", 1.0)):
        q = gibbs.path_precision(6, kind, rho, 1.0, level=0.0)
        last, before = path_step(kind, rho)
        assert np.allclose(-q[5, :5] / q[5, 5], [0, 0, 0, before, last])


@pytest.mark.parametrize("moving", [{"dynamic_ab": True}, {"rank": 1, "dynamic_uv": "ar1"}, {"rank": 1, "dynamic_uv": "snap", "dynamic_ab": True}])
def test_symmetric_networks_stay_symmetric(spark, moving):
    p, _ = panel(7, periods=4, symmetric=True, seed=5, rank=1)
    fit = m.sampled_fit(m.Data.of(frame(spark, p), ["x"]), symmetric=True, **SHORT, **moving)
    ahead = {(r.draw, r.h, r.i, r.j): r.value for r in fit.forecast(2, by_draw=True, kind="link").collect()}
    assert len(ahead) == 2 * 49 * len({k[0] for k in ahead})
    assert all(abs(v - ahead[d, h, j, i]) < 1e-9 for (d, h, i, j), v in ahead.items())
    chain = Chain(p, Options(symmetric=True, **SHORT, **moving))
    a, b = chain.additive_ahead()
    assert (a == b).all()
    product = chain.multiplicative_ahead()
    assert np.allclose(product, product.T)


def test_absent_sides_stay_absent(spark):
    p, _ = panel(7, periods=4, seed=6)
    data = m.Data.of(frame(spark, p), ["x"])
    fit = m.sampled_fit(data, dynamic_ab=True, col_effects=False, **SHORT)
    last = data.dyads.agg(F.max("t")).first()[0]
    moved = m.advance(fit, last, 2, 1)
    assert moved.where("block = 'b' and value <> 0").isEmpty() and not moved.where("block = 'a' and value <> 0").isEmpty()
    chain = Chain(p, Options(dynamic_ab=True, col_effects=False, **SHORT))
    assert (chain.additive_ahead()[1] == 0).all()


def test_walks_of_second_order_go_on_straight(spark):
    p, _ = panel(8, periods=5, seed=8, paths=True)
    data = m.Data.of(frame(spark, p), ["x"])
    fit = m.sampled_fit(data, dynamic_beta=("x_dyad",), beta_kind="rw2", **SHORT)
    quiet = m.BayesFit(fit.data, fit.options, fit.draws.withColumn("value", F.when(F.col("term").startswith("sigma2_beta"), 0.0).otherwise(F.col("value"))))
    moved = {(r.draw, r.t): r.value for r in m.advance(quiet, 5, 2, 1).where("block = 'beta' and term = 'x_dyad'").collect()}
    path = {(r.draw, r.t): r.value for r in fit.draws.where("block = 'beta' and term = 'x_dyad' and draw > 0").collect()}
    for draw in {k[0] for k in moved}:
        step = path[draw, 5] - path[draw, 4]
        assert np.isclose(moved[draw, 1], path[draw, 5] + step) and np.isclose(moved[draw, 2], path[draw, 5] + 2 * step)


def test_held_out_density_is_that_of_the_forecast(spark):
    """Without moving parts both go through the same draws, so they are equal."""
    p, _ = panel(8, periods=4, seed=9)
    options = Options(keep_gof=False, **SHORT)
    held = future(spark, p, options, 4)
    past = m.Data.of(frame(spark, p).where("t < 4"), ["x"])
    fit = m.sampled_fit(past, keep_gof=False, **SHORT)
    cells = m.Data.of(frame(spark, p).where("t = 4"), ["x"]).dyads
    eta = fit.forecast(1, newdata=cells.drop("y").withColumn("t", F.lit(1)), by_draw=True, kind="link")
    ve = fit.block("vc").where("term = 've' and draw > 0").select("chain", "draw", F.col("value").alias("ve"))
    seen = eta.join(ve, ["chain", "draw"]).join(cells.select("i", "j", "y").where("y is not null"), ["i", "j"])
    density = F.exp(-0.5 * F.pow(F.col("y") - F.col("value"), 2) / F.col("ve")) / F.sqrt(2 * np.pi * F.col("ve"))
    total = seen.groupBy("i", "j").agg(F.log(F.avg(density)).alias("d")).agg(F.sum("d")).first()[0]
    assert np.isclose(total, held, rtol=0.05)


def test_update_of_a_process_knows_its_first_state():
    """rho and variance drawn from prior, path and update have the prior's moments, with and without weights."""
    rng = np.random.default_rng(12)
    for weights in (False, True):
        draws = []
        for _ in range(3000):
            rho = float(gibbs.dist.truncated_normal(rng, np.array([0.9]), 0.1, 0.0, 0.995)[0])
            sigma2 = gibbs.inverse_gamma(rng, 2.0, 1.0)
            x = np.zeros((3, 4))
            x[:, 0] = rng.normal(0, (sigma2 / (1 - rho**2)) ** 0.5, 3)
            w = rng.gamma(2, 0.5, (3, 3)) if weights else np.ones((3, 3))
            for t in range(1, 4):
                x[:, t] = rho * x[:, t - 1] + rng.normal(size=3) * (sigma2 / w[:, t - 1]) ** 0.5
            new = rho, sigma2
            for _ in range(3):
                new = gibbs.ar1_update(rng, x, new[0], weights=w if weights else None)
            draws.append((rho, new[0], 1 / sigma2, 1 / new[1]))
        d = np.array(draws)
        error = lambda a, b: abs(a.mean() - b.mean()) / (a.var() / len(a) + b.var() / len(b)) ** 0.5
        assert error(d[:, 0], d[:, 1]) < 4 and error(d[:, 2], d[:, 3]) < 4
