"""Fits recover known parameters, and what is derived from them keeps its contracts."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F
from simulated import frame, panel

from relata.functions import distributions as dist
from relata.plans import models as m
from relata.plans.als import Als, AlsOptions
from relata.plans.gibbs import FAMILIES, Chain, Options, ar1_precision, path_precision

QUICK = {"burn": 100, "scan": 300, "thin": 5}


def test_distributions():
    x = np.linspace(-30, 8, 200)
    n = NormalDist()
    assert np.allclose(dist.ndtr(x), [n.cdf(v) for v in x], atol=1e-14)
    assert np.allclose(dist.log_ndtr(x[x > -35]), [math.log(0.5 * math.erfc(-v / 2**0.5)) for v in x[x > -35]], rtol=1e-9)
    p = np.array([1e-12, 1e-4, 0.3, 0.5, 0.9, 1 - 1e-9])
    assert np.allclose(dist.ndtri(p), [n.inv_cdf(v) for v in p], atol=1e-7)
    rng = np.random.default_rng(1)
    for low, high, mean in ((0, np.inf, -3.0), (-np.inf, 0, 12.0), (1, 1.2, 0.0), (-np.inf, np.inf, 2.0)):
        z = dist.truncated_normal(rng, np.full(20000, mean), 1.0, low, high)
        assert (z >= low).all() and (z <= high).all()
        a, b = low - mean, high - mean
        mass = math.exp(float(dist.log_ndtr_difference(np.array(b), np.array(a)))) if np.isfinite([a, b]).any() else 1.0
        pdf = lambda v: 0.0 if np.isinf(v) else math.exp(-v * v / 2) / math.sqrt(2 * math.pi)
        assert abs(z.mean() - (mean + (pdf(a) - pdf(b)) / mass)) < 0.03
    y, eta = np.arange(5.0), np.full(5, 0.4)
    grid = np.linspace(-8, 8, 20001)
    exact = [math.log(np.trapezoid(np.exp(dist.poisson_log(k, grid) + dist.dnorm_log(grid, 0.4, 0.7)), grid)) for k in y]
    assert np.allclose(dist.poisson_marginal_log(y, eta, 0.49), exact, atol=1e-6)
    assert np.allclose(dist.halton(3, 2, burn=0), [0.5, 0.25, 0.75])
    assert abs(math.exp(dist.rank_probability_log(np.zeros(4), np.array([2, 0, 1, 3]), 2000)) - 1 / 24) < 0.002


def test_path_precisions():
    q = ar1_precision(4, 0.6, 2.0)
    lag = np.abs(np.arange(4)[:, None] - np.arange(4))
    assert np.allclose(np.linalg.inv(q), 2.0 / (1 - 0.36) * 0.6**lag)
    gaps = ar1_precision(3, 0.6, 2.0, np.array([1.0, 2.0]))
    assert np.allclose(np.linalg.inv(gaps), 2.0 / (1 - 0.36) * 0.6 ** np.abs(np.array([0, 1, 3])[:, None] - np.array([0, 1, 3])))
    line = np.arange(5.0)
    assert abs(line @ path_precision(5, "rw2", level=0.0) @ line) < 1e-9


@pytest.mark.parametrize("family", FAMILIES)
@pytest.mark.parametrize("shape", ["square", "symmetric", "rectangle"])
def test_sampler_recovers_the_slope(family, shape):
    if shape == "symmetric" and family in ("cbin", "frn"):
        with pytest.raises(ValueError):
            Options(family=family, symmetric=True)
        return
    p, _ = panel(24, 18 if shape == "rectangle" else None, family=family, symmetric=shape == "symmetric", seed=3)
    chain = Chain(p, Options(family=family, symmetric=shape == "symmetric", keep_gof=False, **QUICK))
    draws = chain.run().frame()
    got = draws[(draws.block == "beta") & (draws.term == "x_dyad")].value.mean()
    want = 0.8 if family in ("normal", "poisson") else 0.8 / 0.7
    assert abs(got - want) < (0.15 if family in ("normal", "poisson") else 0.4)


def test_reciprocity_is_recovered():
    rng = np.random.default_rng(5)
    p, _ = panel(30, seed=4, noise=0.0)
    e = rng.normal(size=(30, 30))
    upper = np.triu(e, 1)
    mixed = upper + 0.6 * upper.T + 0.8 * np.tril(rng.normal(size=(30, 30)), -1)
    chain = Chain(p.with_y(p.y + mixed[:, :, None]), Options(keep_gof=False, **QUICK))
    draws = chain.run().frame()
    assert abs(draws[draws.term == "rho"].value.mean() - 0.6) < 0.12


@pytest.mark.parametrize("settings", [{"dynamic_beta": ("x_dyad",)}, {"dynamic_beta": ("x_dyad",), "beta_kind": "matern32"}, {"dynamic_beta": ("x_dyad",), "beta_kind": "rw2"}])
def test_moving_slopes_are_recovered(settings):
    p, slopes = panel(18, periods=5, seed=6, paths=True)
    draws = Chain(p, Options(keep_gof=False, **QUICK, **settings)).run().frame()
    got = draws[(draws.block == "beta") & (draws.term == "x_dyad")].groupby("t").value.mean().to_numpy()
    assert np.abs(got - slopes).max() < 0.15


@pytest.mark.parametrize("kind", ["ar1", "snap", "t"])
@pytest.mark.parametrize("m_size", [None, 9])
def test_moving_factors_run_and_fit(kind, m_size):
    p, _ = panel(12, m_size, periods=4, rank=1, seed=7)
    chain = Chain(p, Options(rank=1, dynamic_uv=kind, dynamic_ab=True, dynamic_g=m_size is not None, keep_gof=False, burn=80, scan=120, thin=5))
    draws = chain.run().frame()
    eta = draws[draws.block == "eta_mean"].value.to_numpy()
    assert np.isfinite(draws.value).all()
    off = np.broadcast_to(chain.off[:, :, None], p.shape)
    assert np.corrcoef(eta, p.y[off])[0, 1] > 0.8


def test_point_estimates():
    p, slopes = panel(15, periods=4, seed=8, paths=True)
    free = Als(p, AlsOptions(dynamic_beta=("x_dyad",), lambda_beta=0.0)).run()
    assert np.abs(free.beta[0] - slopes).max() < 0.15
    stiff = Als(p, AlsOptions(dynamic_beta=("x_dyad",), lambda_beta=1e9)).run()
    assert np.ptp(stiff.beta[0]) < 1e-3
    q, _ = panel(40, rank=2, seed=9)
    fit = Als(q, AlsOptions(rank=2)).run()
    assert fit.converged and abs(fit.beta[0, 0] - 0.8) < 0.1 and abs(fit.components()["ve"] - 0.49) < 0.08
    hidden = q.y.copy()
    hidden[::3, ::4] = np.nan
    lossy = Als(q.with_y(hidden), AlsOptions(rank=2)).run()
    lost = np.isnan(hidden) & ~np.isnan(q.y)
    assert np.corrcoef(lossy.eta()[lost], q.y[lost])[0, 1] > 0.7
    with pytest.raises(ValueError):
        AlsOptions(family="frn")


@pytest.mark.parametrize("family", ["binary", "poisson"])
def test_reweighted_point_estimates(family):
    p, _ = panel(40, family=family, seed=10)
    fit = Als(p, AlsOptions(family=family)).run()
    assert abs(fit.beta[0, 0] - (0.8 / 0.7 if family == "binary" else 0.8)) < 0.3


def test_snaps_are_found():
    rng = np.random.default_rng(11)
    n, t = 20, 6
    u = rng.normal(size=(n, 1))
    path = np.repeat(u[:, :, None], t, 2)
    path[3, :, 3:] = -2.5 * np.sign(path[3, :, :1])
    y = np.einsum("irt,jrt->ijt", path, np.repeat(rng.normal(size=(n, 1))[:, :, None], t, 2)) + 0.2 * rng.normal(size=(n, n, t))
    p, _ = panel(n, periods=t, seed=1)
    fit = Als(p.with_y(np.where(np.isnan(p.y), np.nan, y)), AlsOptions(rank=1, dynamic_uv="snap", max_iter=60)).run()
    assert fit.q_u[3, 3] == fit.q_u[:, 1:].max()


@pytest.fixture(scope="module")
def fitted(spark):
    p, _ = panel(14, seed=12)
    data = m.Data.of(frame(spark, p), ["x"])
    return p, m.sampled_fit(data, rank=1, n_chains=2, keep_loglik=True, **QUICK)


def test_contracts_of_a_sampled_fit(spark, fitted):
    p, fit = fitted
    coef = {r.term: r.estimate for r in fit.coef().collect()}
    pdf = fit.beta.toPandas()
    for term, e in coef.items():
        values = pdf[pdf.term == term].value
        assert math.isclose(e, values.mean(), abs_tol=1e-10)
        low, high = np.quantile(values, [0.025, 0.975])
        r = fit.confint().where(F.col("term") == term).first()
        assert math.isclose(r.conf_low, low, abs_tol=1e-8) and math.isclose(r.conf_high, high, abs_tol=1e-8)
        assert low < {"intercept": 0.3, "x_dyad": 0.8}[term] + 0.6 and coef["x_dyad"] > 0.5
    both = fit.data.dyads.join(fit.fitted(), ["t", "i", "j"]).join(fit.residuals(), ["t", "i", "j"]).where("y is not null").toPandas()
    assert np.abs(both.y - both.value - both.residual).max() < 1e-9
    made = fit.predict(fit.data.dyads, "link").join(fit.eta().withColumnRenamed("value", "kept"), ["t", "i", "j"]).where("i <> j").toPandas()
    assert np.abs(made.value - made.kept).max() < 1e-6
    shifted = fit.predict(fit.data.dyads.withColumn("x_dyad", F.col("x_dyad") + 1), "link").join(fit.eta().withColumnRenamed("value", "kept"), ["t", "i", "j"]).toPandas()
    assert np.abs(shifted.value - shifted.kept - coef["x_dyad"]).max() < 1e-6
    assert fit.summary().where("block = 'beta' and rhat is not null and ess > 0").count() == 2
    assert fit.glance().first().nobs == 14 * 13


def test_likelihoods_gof_and_simulation(spark, fitted):
    p, fit = fitted
    waic, loo = fit.waic().first(), fit.loo().first()
    assert waic.n_obs == 14 * 13 and abs(waic.elpd_waic - loo.elpd_loo) < 0.1 * abs(waic.elpd_waic)
    again = fit.loglik().agg(F.sum("ll")).first()[0]
    other = m.BayesFit(fit.data, m.replace(fit.options, keep_loglik=False), fit.draws, 2).loglik().agg(F.sum("ll")).first()[0]
    assert math.isclose(again, other, rel_tol=1e-6)
    assert {r.term for r in fit.gof().collect()} == {"sd_row", "sd_col", "dyad_dep", "cycle_dep", "trans_dep"}
    one, two = (sorted(map(tuple, fit.simulate(5).collect())) for _ in range(2))
    assert one == two and len(one) == 5 * 14 * 13
    custom = fit.gof_custom({"mean": F.avg("y"), "top": lambda f: f.y.max()}, 3).toPandas()
    assert set(custom.term) == {"mean", "top"} and custom.observed.notna().all()
    with pytest.raises(m.NotAvailable):
        fit.log_lik()


def test_save_load_and_resume(spark, fitted, tmp_path):
    _, fit = fitted
    fit.save(f"file://{tmp_path}/fit")
    back = m.BayesFit.load(spark, f"file://{tmp_path}/fit")
    assert back.options == fit.options and back.draws.count() == fit.draws.count()
    fit.save(f"file://{tmp_path}/small", packed=True)
    small = m.BayesFit.load(spark, f"file://{tmp_path}/small")
    assert small.options == fit.options and small.draws.exceptAll(fit.draws).isEmpty() and small.draws.count() == fit.draws.where("value is not null").count()
    more = fit.resume(50)
    assert more.beta.agg(F.max("draw")).first()[0] == fit.beta.agg(F.max("draw")).first()[0] + 10


def test_forecasts_and_future(spark):
    p, _ = panel(10, periods=4, seed=13, paths=True)
    data = m.Data.of(frame(spark, p), ["x"])
    fit = m.sampled_fit(data, dynamic_beta=True, dynamic_ab=True, **QUICK)
    ahead = fit.forecast(2)
    assert ahead.count() == 2 * 100 and ahead.where("value is null").isEmpty()
    lfo = m.leave_future_out(data, Options(burn=50, scan=50, thin=5), [3, 4]).collect()
    assert sorted((r.period, r.n) for r in lfo) == [(3, 90), (4, 90)] and all(math.isfinite(r.elpd) for r in lfo)
    changes = fit.change_points(100).collect()
    assert {c.term for c in changes} == {"intercept", "x_dyad"}
    out = m.forecast_pit(fit, data.dyads.where("t = 4").select("i", "j", "y"), 1).first()
    assert 0 <= out.ks <= 1 and out.n == 90


def test_point_fit_objects(spark):
    p, _ = panel(16, seed=14)
    data = m.Data.of(frame(spark, p), ["x"])
    fit = m.point_fit(data)
    t = {r.term: r for r in fit.tidy().collect()}
    assert t["x_dyad"].conf_low < 0.85 and t["x_dyad"].conf_high > 0.75 and t["x_dyad"].p_value < 0.01
    boot = fit.bootstrap(8)
    assert boot.bootstrap_interval().count() == 2 and boot.vcov().count() == 4
    direct = Als(p, AlsOptions()).run()
    assert math.isclose(t["x_dyad"].estimate, direct.beta[0, 0], abs_tol=1e-9)
    assert fit.simulate(2).count() == 2 * 16 * 15
    res = fit.residuals().where("residual is not null").toPandas()
    assert abs(res.residual.mean()) < 1e-6
    with pytest.raises(m.NotAvailable):
        fit.waic()


def test_pooled_panels_and_actor_slopes(spark):
    frames = []
    for k in range(2):
        p, _ = panel(10, seed=20 + k)
        frames.append(frame(spark, p).withColumn("panel", F.lit(f"p{k}")).withColumn("intercept", F.lit(1.0)).withColumnRenamed("x", "x_dyad"))
    pooled = m.pooled_fits(frames[0].unionByName(frames[1]), ["intercept", "x_dyad"], Options(keep_gof=False, **QUICK))
    rows = pooled.where("term = 'x_dyad'").collect()
    assert len(rows) == 2 and abs(rows[0].pooled - 0.8) < 0.2
    slopes = m.per_actor_slopes(frames[0].withColumn("residual", 2 * F.col("x_dyad")), "x_dyad").collect()
    assert all(abs(r.slope - 2) < 1e-3 for r in slopes)


@pytest.mark.parametrize("factor", [0.7, -0.02, 0.0])
def test_draws_with_a_rank_one_precision(factor):
    from relata.functions.linear import rank_one_draw

    rng = np.random.default_rng(1)
    d, w, b = np.array([2.0, 3.0, 1.5]), np.array([1.0, -2.0, 0.5]), np.array([1.0, 0.3, -2.0])
    precision = np.diag(d) + factor * np.outer(w, w)
    x = np.stack([rank_one_draw(rng, d, factor, w, b) for _ in range(40000)])
    assert np.allclose(x.mean(0), np.linalg.solve(precision, b), atol=0.02)
    assert np.allclose(np.cov(x.T), np.linalg.inv(precision), atol=0.03)


def test_additive_effects_have_the_joint_conditional():
    """Draws given everything else, against the dense conditional of both effects under reciprocity."""
    p, _ = panel(6, seed=21)
    chain = Chain(p, Options(keep_gof=False))
    chain.rho[:], chain.s2, chain.sab = 0.5, 0.7, np.array([[0.8, 0.3], [0.3, 0.5]])
    e, n = np.random.default_rng(2).normal(size=(6, 6, 1)), 6
    cells = [(i, j) for i in range(n) for j in range(n) if i != j]
    design = np.zeros((len(cells), 2 * n))
    cov = np.zeros((len(cells), len(cells)))
    for k, (i, j) in enumerate(cells):
        design[k, i], design[k, n + j], cov[k, k] = 1, 1, 0.7
        cov[k, cells.index((j, i))] = 0.35
    white = np.linalg.inv(cov)
    precision = design.T @ white @ design + np.kron(np.linalg.inv(chain.sab), np.eye(n))
    mean = np.linalg.solve(precision, design.T @ white @ np.array([e[i, j, 0] for i, j in cells]))
    draws = []
    for _ in range(20000):
        chain.sab = np.array([[0.8, 0.3], [0.3, 0.5]])
        chain.draw_additive(e)
        draws.append(np.concatenate([chain.a[:, 0], chain.b[:, 0]]))
    draws = np.stack(draws)
    assert np.allclose(draws.mean(0), mean, atol=0.03) and np.allclose(np.cov(draws.T), np.linalg.inv(precision), atol=0.03)


def test_factors_have_the_joint_conditional():
    p, _ = panel(5, seed=22)
    chain = Chain(p, Options(rank=1, keep_gof=False))
    chain.rho[:], chain.s2 = 0.5, 0.7
    e, n = np.random.default_rng(3).normal(size=(5, 5, 1)), 5
    v0 = np.random.default_rng(4).normal(size=(5, 1, 1))
    cells = [(i, j) for i in range(n) for j in range(n) if i != j]
    design, cov = np.zeros((len(cells), n)), np.zeros((len(cells), len(cells)))
    for k, (i, j) in enumerate(cells):
        design[k, i], cov[k, k], cov[k, cells.index((j, i))] = v0[j, 0, 0], 0.7, 0.35
    white = np.linalg.inv(cov)
    precision = design.T @ white @ design + np.eye(n)
    mean = np.linalg.solve(precision, design.T @ white @ np.array([e[i, j, 0] for i, j in cells]))
    draws = []
    for _ in range(20000):
        chain.suv = (np.ones(1), np.ones(1))
        chain.v = v0.copy()
        chain._square_factors(e)
        draws.append(chain.u[:, 0, 0].copy())
    draws = np.stack(draws)
    assert np.allclose(draws.mean(0), mean, atol=0.03) and np.allclose(np.cov(draws.T), np.linalg.inv(precision), atol=0.03)


def test_start_values_updates_and_positions(spark):
    p, _ = panel(10, periods=3, rank=1, seed=30)
    data = m.Data.of(frame(spark, p), ["x"])
    fit = m.sampled_fit(data, rank=1, dynamic_uv="ar1", start=True, burn=20, scan=40, thin=10, keep_gof=False)
    assert abs(fit.coef().where("term = 'x_dyad'").first().estimate - 0.8) < 0.2
    assert fit.update(scan=20).beta.select("draw").distinct().count() == 2
    assert fit.aligned_positions().count() == 30
    c = fit.centred_multiplicative().toPandas()
    assert abs(c.groupby("t").value.mean()).max() < 1e-9
    assert m.memory_estimate(1000)["panel"] == 16_000_000
    assert fit.trace().agg({"iteration": "max"}).first()[0] == 4 and fit.top_positions(3).count() == 3
    own = m.sampled_fit(data, actor_slope="x_dyad", dynamic_ab=True, burn=20, scan=40, thin=10, keep_gof=False)
    both = own.predict(data.dyads, "link").join(own.eta().withColumnRenamed("value", "kept"), ["t", "i", "j"]).where("i <> j").toPandas()
    assert np.abs(both.value - both.kept).max() < 1e-6 and own.most_variable_effects(4).count() == 4


def test_scratch_is_removed(spark):
    from relata import session

    kept = session._SCRATCH[:]
    session._SCRATCH.clear()
    session.written(spark.range(3), "x")
    assert session.remove_scratch(spark) == 1
    session._SCRATCH.extend(kept)


def test_explicit_cutpoints_are_recovered():
    p, _ = panel(24, family="ordinal", seed=31)
    draws = Chain(p, Options(family="ordinal", cutpoints="explicit", keep_gof=False, burn=300, scan=300, thin=5)).run().frame()
    vc = draws[draws.block == "vc"].groupby("term").value.mean()
    gaps = np.diff([vc["cut_1"], vc["cut_2"], vc["cut_3"]])
    assert np.allclose(gaps, 1 / 0.7, atol=0.3)


def test_actor_slopes_and_pooled_paths():
    p, _ = panel(16, periods=4, seed=32)
    own = np.random.default_rng(5).normal(0, 0.8, 16)
    own -= own.mean()
    y = p.y + p.x[:, :, 1] * own[:, None, None]
    draws = Chain(p.with_y(y), Options(actor_slope="x_dyad", keep_gof=False, **QUICK)).run().frame()
    got = draws[draws.block == "slope"].groupby("i").value.mean().to_numpy()
    assert np.corrcoef(got, own)[0, 1] > 0.97 and abs(got.mean()) < 1e-9
    q, slopes = panel(14, periods=5, seed=33, paths=True)
    draws = Chain(q, Options(dynamic_beta=True, pool_beta=True, keep_gof=False, **QUICK)).run().frame()
    assert np.abs(draws[draws.term == "x_dyad"].groupby("t").value.mean().to_numpy() - slopes).max() < 0.2
    with pytest.raises(ValueError):
        Options(cutpoints="none")


def test_registered_fits_run_at_their_default_lengths(spark, monkeypatch):
    from relata import registry

    class Stop(Exception):
        pass

    seen = []

    def stop(*args, **named):
        seen.append((args, named))
        raise Stop

    monkeypatch.setattr(m, "sampled_fit", stop)
    monkeypatch.setattr(m, "leave_future_out", stop)
    monkeypatch.setattr(m, "point_fit", lambda *args, **named: type("Fit", (), {"bootstrap": staticmethod(stop)}))
    for name in ("fit_sampled", "fit_goodness", "fit_forecast", "fit_binary_bipartite", "fit_leave_future_out", "fit_bootstrap"):
        with pytest.raises(Stop):
            registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not [n for _, n in seen if {"burn", "scan", "thin", "n"} & set(n)]
    assert seen[4][0][1] == Options() and seen[5] == ((), {})


@pytest.mark.parametrize("kind,variance", [("ar1", 1.0), ("snap", 0.7 + 0.3 * 9), ("t", 1.5)])
def test_positions_go_on_by_their_own_process(spark, kind, variance):
    """One step from zero has the variance of a drift, of a drift or a reset, or of a Student-t with six degrees of freedom."""
    n = 6000
    vc = [(k % 2, k + 1, "vc", t, None, None, None, v) for k in range(n) for t, v in (("rho_uv", 0.5), ("sigma2_uv", 1.0), ("pi_snap", 0.3))]
    rows = [(k % 2, k + 1, "u", str(r), 5, "a", None, 2.0 * r) for k in range(n) for r in (0, 1)] + vc
    draws = spark.createDataFrame(rows, "chain int, draw int, block string, term string, t int, i string, j string, value double").cache()
    options = Options(dynamic_uv=kind, rank=2, prior={"kappa": 3.0, "nu": 6})
    fit = type("Fit", (), {"options": options, "draws": draws, "block": lambda self, b: draws.where(F.col("block") == b)})()
    got = {(r.term, r.t): (r.m, r.v) for r in m.advance(fit, 5, 2, 3).where("block = 'u'").groupBy("term", "t").agg(F.avg("value").alias("m"), F.variance("value").alias("v")).collect()}
    assert got[("0", 1)][1] == pytest.approx(variance, rel=0.15) and abs(got[("0", 1)][0]) < 0.15
    stay = 0.7 if kind == "snap" else 1.0
    assert got[("1", 1)][0] == pytest.approx(stay * 1.0, abs=0.15) and got[("1", 2)][0] == pytest.approx(stay**2 * 0.5, abs=0.15)
