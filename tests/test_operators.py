"""Edge sources, statistics and summaries on small fixtures with hand-made results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.operators import design, evaluation, regression, statistics, summaries
from relata.sources import edges

EDGES = [(1, "a", "b", 1.0, 1), (1, "a", "b", 3.0, 2), (1, "b", "c", 2.0, 1), (1, "c", "a", 1.0, 1), (2, "a", "c", 5.0, 1)]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(EDGES, "t int, i string, j string, y double, n int")


def cells(df, *by):
    return {tuple(r[b] for b in (*by, "i", "j")): r["y"] for r in df.collect()}


def test_edge_lists(spark, listed):
    got = cells(edges.edges_to_dyads(listed, order="n"), "t")
    assert len(got) == 18 and got[(1, "a", "b")] == 3.0 and got[(1, "b", "a")] == 0.0 and got[(2, "b", "b")] is None
    assert cells(edges.edges_to_dyads(listed, dedupe="sum"), "t")[(1, "a", "b")] == 4.0
    both = cells(edges.edges_to_dyads(listed, directed=False, order="n"), "t")
    assert both[(1, "b", "a")] == both[(1, "a", "b")] == 3.0
    loops = spark.createDataFrame([(1, "a", "a", 2.0), (1, "a", "b", 1.0)], edges.DYADS)
    assert cells(edges.edges_to_dyads(loops), "t")[(1, "b", "b")] == 0.0
    back = edges.dyads_to_edges(edges.edges_to_dyads(listed, order="n"))
    assert [tuple(r) for r in back.collect()] == [(1, "a", "b", 3.0), (1, "b", "c", 2.0), (1, "c", "a", 1.0), (2, "a", "c", 5.0)]
    one = spark.createDataFrame([(1, "0", "b", 2.0)], edges.DYADS)
    assert edges.dyads_to_edges(edges.edges_to_dyads(one)).columns == ["t", "i", "j", "y"]
    assert edges.dyads_to_edges(edges.edges_to_dyads(one.withColumn("y", F.lit(1.0)).union(one.withColumn("y", F.lit(1.0)).select("t", "j", "i", "y")))).columns == ["t", "i", "j"]


def test_changing_actors_and_formats(spark, listed):
    some = listed.where("t = 2 or n = 1").select("t", "i", "j", "y")
    aligned = edges.align_panel(some).collect()
    assert len(aligned) == 18 and not [r for r in aligned if r.t == 2 and "b" in (r.i, r.j) and (r.present or r.y is not None)]
    with pytest.raises(edges.FormatError):
        edges.check_format(listed.select("t", "i", "j", "y"))
    with pytest.raises(edges.FormatError):
        edges.check_format(listed.select("t", "i", "j"))
    edges.check_format(some, spark.createDataFrame([("a",)], "actor string"))
    with pytest.raises(edges.FormatError):
        edges.check_format(some, spark.createDataFrame([("z",)], "actor string"))
    m = cells(edges.from_matrices(spark, [np.array([[0, 1], [np.nan, 0]])]), "t")
    assert m == {(0 + 1, "1", "1"): None, (1, "1", "2"): 1.0, (1, "2", "1"): None, (1, "2", "2"): None}
    with pytest.raises(TypeError):
        edges.as_dyads(spark, spark.createDataFrame([("a", "b", "x")], "i string, j string, y string"))


def test_statistics_on_small_networks(spark):
    square = [(1, i, j, float(v)) for (i, j), v in {("x", "p"): 1, ("x", "q"): 1, ("y", "p"): 1, ("y", "q"): 1, ("z", "p"): 1, ("z", "r"): 0}.items()]
    f = spark.createDataFrame(square, edges.DYADS)
    for side in ("row", "col", None):
        r = statistics.four_cycles(f, side=side).first()
        assert (r.four_cycles, r.clustering) == (1, 1.0)
    empty = spark.createDataFrame([(1, "x", "p", 0.0)], edges.DYADS)
    assert tuple(statistics.four_cycles(empty).first()) == (1, 0, 0.0)
    rng = np.random.default_rng(1)
    y = rng.poisson(2.0, (6, 6)).astype(float)
    np.fill_diagonal(y, np.nan)
    y[0, 3] = np.nan
    rows = [(1, str(i), str(j), None if np.isnan(y[i, j]) else float(y[i, j])) for i in range(6) for j in range(6)]
    from relata.plans.gibbs import matrix_statistics

    want = matrix_statistics(y, True)
    for method in ("wedges", "grid"):
        got = statistics.unipartite_statistics(spark.createDataFrame(rows, edges.DYADS), method=method).first()
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), (method, got, want)
    flat = spark.createDataFrame([(1, a, b, 1.0) for a in "abc" for b in "abc" if a != b], edges.DYADS)
    assert set(statistics.unipartite_statistics(flat).first()[1:]) == {0.0}
    with pytest.raises(ValueError):
        statistics.period_statistic(flat, "nothing")


def test_temporal_trend(spark):
    rows = [(t, a, b, float((ord(a) + ord(b)) % 4 < t)) for t in (1, 2, 3) for a in "abcd" for b in "abcd" if a != b]
    seen = spark.createDataFrame(rows, edges.DYADS)
    reps = seen.crossJoin(spark.range(4).withColumnRenamed("id", "rep")).withColumn("y", F.lit(1.0) - F.lit(0.0))
    r = statistics.temporal_trend(seen, reps, "mean").first()
    assert r.slope > 0 and r.p == 1.0 and r.n_rep == 4


def test_design_and_missing(spark):
    d = spark.createDataFrame([(1, "a", "b", 1.0, 2.0), (1, "b", "a", 2.0, None), (1, "a", "c", 3.0, 1.0)], "t int, i string, j string, y double, w double")
    nodes = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "actor string, s double")
    x, names = design.design(d, ["w"], nodes, ["s"])
    assert names == ["intercept", "w_dyad", "s_row"]
    assert {(r.i, r.j): r.y for r in x.collect()} == {("a", "b"): 1.0, ("b", "a"): None, ("a", "c"): 3.0}
    constant, names = design.design(d.withColumn("k", F.lit(1.0)), ["k"])
    assert "intercept" not in names
    assert design.suffixed("x.dyad", "_dyad") == design.suffixed("x", "dyad") == design.suffixed("x_dyad", "_dyad") == "x_dyad"
    level = design.nodal_pair(spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "v")], "actor string, g string"), "g", "factor").where("i = 'a' and j = 'b' and level = 'u'").first()
    assert level.value == 2.0
    z = {r.y: None if r.z is None else round(r.z, 6) for r in design.normal_scores(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "y double")).collect()}
    from statistics import NormalDist

    assert z[None] is None and z[1.0] == round(NormalDist().inv_cdf(0.25), 6) and z[2.0] == round(NormalDist().inv_cdf(2.5 / 4), 6)


def test_additive_effects_against_dense_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = [(1, str(i), str(j), float(rng.normal() + i - 2 * j)) for i in range(5) for j in range(4) if (i, j) != (2, 3)]
    a, b, mu = regression.additive_effects(spark.createDataFrame(rows, edges.DYADS), sweeps=40)
    ea, eb = ({r.actor: r.effect for r in x.collect()} for x in (a, b))
    x = np.zeros((len(rows), 9))
    for k, (_, i, j, _) in enumerate(rows):
        x[k, int(i)], x[k, 5 + int(j)] = 1, 1
    fit = x @ np.linalg.lstsq(x, np.array([r[3] for r in rows]), rcond=None)[0]
    assert np.allclose([mu + ea[i] + eb[j] for _, i, j, _ in rows], fit, atol=1e-6)


def test_sandwich_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 7
    cells_ = [(1, str(i), str(j), float(rng.normal()), 1.0, float(rng.normal())) for i in range(n) for j in range(n) if i != j]
    d = spark.createDataFrame(cells_, "t int, i string, j string, residual double, one double, x double")
    x, e = np.array([[c[4], c[5]] for c in cells_]), np.array([c[3] for c in cells_])
    bread = np.linalg.inv(x.T @ x)
    pairs = {}
    for k, c in enumerate(cells_):
        pairs.setdefault(tuple(sorted(c[1:3])), []).append(k)
    s = np.array([sum(x[k] * e[k] for k in ks) for ks in pairs.values()])
    assert np.allclose(regression.sandwich(d, ["one", "x"]), bread @ s.T @ s @ bread)
    s = x * e[:, None]
    assert np.allclose(regression.sandwich(d, ["one", "x"], cluster="none"), bread @ s.T @ s @ bread)


def test_summaries_and_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(c, k, "b", float(rng.normal())) for c in range(3) for k in range(50)]
    draws = spark.createDataFrame(rows, "chain int, draw int, term string, value double")
    v = np.array([[r[3] for r in rows if r[0] == c] for c in range(3)])
    w, b = v.var(1, ddof=1).mean(), v.mean(1).var(ddof=1)
    assert abs(summaries.rhat(draws).first().rhat - ((49 / 50 * w + b) / w) ** 0.5) < 1e-12
    ess = summaries.effective_size(draws).first().ess
    assert 60 < ess <= 150
    kept = summaries.saved_draws(draws, 7)
    assert kept.count() == 7 and sorted(map(tuple, kept.collect())) == sorted(map(tuple, summaries.saved_draws(draws.repartition(5), 7).collect()))
    q = {r.prob: r.value for r in summaries.weighted_quantile(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)], "value double, weight double"), (0.25, 0.5, 0.6)).collect()}
    assert q == {0.25: 1.0, 0.5: 2.0, 0.6: 3.0}
    p = spark.createDataFrame([(1.0, 0.9), (0.0, 0.2), (1.0, 0.2), (0.0, 0.1)], "y double, predicted double")
    r = evaluation.evaluate(p, "binary").first()
    assert abs(r.auroc - 3.5 / 4) < 1e-12 and abs(r.auprc - (1.0 + 2 / 3) / 2) < 1e-12
    lf = spark.createDataFrame([(float(k),) for k in range(30)], "y double").select(evaluation.log_factorial(F.col("y")).alias("l")).collect()
    import math

    assert all(abs(x.l - math.lgamma(k + 1)) < 1e-10 for k, x in enumerate(lf))


def test_importance_sampling_of_a_normal():
    from plain import psis_point

    rng = np.random.default_rng(6)
    y = rng.normal(size=40)
    mean = rng.normal(y.mean(), 40**-0.5, 4000)
    got = psis_point(-0.5 * (y[0] - mean) ** 2 - 0.5 * np.log(2 * np.pi))[0]
    rest, v = y[1:].mean(), 1 + 1 / 39
    assert abs(got - (-0.5 * (y[0] - rest) ** 2 / v - 0.5 * np.log(2 * np.pi * v))) < 0.02


def test_effective_sizes_equal_the_plain_ones(spark):
    from plain import chain_ess

    rng = np.random.default_rng(8)
    chains = {}
    for c, (n, rho) in enumerate([(200, 0.9), (101, 0.0), (60, -0.5), (3, 0.0), (4, 0.3), (5, 0.1), (40, None)]):
        x = rng.normal(size=n)
        for k in range(1, n):
            x[k] += (rho or 0.0) * x[k - 1]
        chains[c] = x if rho is not None else np.full(n, 2.5)
    rows = [(c % 2, c // 2, k, float(v)) for c, x in chains.items() for k, v in enumerate(x)]
    draws = spark.createDataFrame(rows, "term int, chain int, draw int, value double").repartition(4)
    got = {r.term: r.ess for r in summaries.effective_size(draws).collect()}
    for term in (0, 1):
        assert np.isclose(got[term], sum(chain_ess(x) for c, x in chains.items() if c % 2 == term))
    assert "Python" not in summaries.effective_size(draws)._jdf.queryExecution().executedPlan().toString()


def test_smoothed_densities_equal_the_plain_ones(spark):
    from plain import psis_point

    rng = np.random.default_rng(9)
    points = {0: -rng.exponential(2.0, 400), 1: -0.5 * rng.normal(size=150) ** 2, 2: -(rng.normal(size=300) ** 4), 3: rng.normal(size=12), 4: np.zeros(80), 5: np.array([-1.0]), 6: -rng.exponential(300.0, 90)}
    rows = [(k, "a", "b", d, float(v)) for k, x in points.items() for d, v in enumerate(x)]
    ll = spark.createDataFrame(rows, "t int, i string, j string, draw int, ll double").repartition(3)
    got = {r.t: (r.elpd, r.k) for r in summaries.psis_loo(ll).collect()}
    for k, x in points.items():
        elpd, shape = psis_point(x)
        assert np.isclose(got[k][0], elpd) and (got[k][1] is None) == bool(np.isnan(shape)), k
        assert np.isnan(shape) or np.isclose(got[k][1], shape)
    assert summaries.psis_loo(ll.limit(0)).count() == 0


def test_alignment_is_one_plan_for_any_number_of_periods(spark):
    from relata.operators import dyads

    rng = np.random.default_rng(3)
    base, periods = rng.normal(size=(12, 3)), list(range(3, 15))
    rows, want, turn, last = [], {}, np.eye(3), None
    for t in periods:
        now = (base + 0.05 * rng.normal(size=base.shape)) @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
        here = [k for k in range(12) if (k + t) % 5]
        if last is not None:
            both = [k for k in here if k in last[0]]
            u, _, v = np.linalg.svd(now[both].T @ last[1][both] @ turn)
            turn = u @ v
        want |= {(t, k): now[k] @ turn for k in here}
        rows += [(t, str(k), [float(x) for x in now[k]]) for k in here]
        last = here, now
    table = spark.createDataFrame(rows, "t int, actor string, u array<double>")
    out = dyads.aligned_over_time(table, 3)
    got = {(r.t, int(r.actor)): r.u for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(dyads.aligned_over_time(table.where("t < 99"), 3)) == size(dyads.aligned_over_time(table.where("t < 5"), 3))
    assert dyads.aligned_over_time(table.limit(0), 3).count() == 0


def test_rank_probabilities(spark):
    """Folds over nodes against numpy's, and known probabilities of orders."""
    from relata.functions.distributions import rank_probability_log
    from relata.operators import rankings

    rng = np.random.default_rng(6)
    cases = {k: (rng.normal(size=n).tolist(), rng.normal(-1, 1, m).tolist()) for k, (n, m) in enumerate([(4, 0), (3, 3), (1, 5), (6, 2), (0, 3)])}
    cases[9] = ([0.0] * 3, [])
    cases[10] = ([-6.0, 0.0, 3.0], [6.0])  # far from likely
    table = spark.createDataFrame([(k, e, f) for k, (e, f) in cases.items()], "k int, e array<double>, f array<double>")
    got = {r.k: r.log_probability for r in rankings.rank_log_probability(table, ["k"], 256).collect()}
    for k, (e, f) in cases.items():
        eta = np.array(e + f)
        want = rank_probability_log(eta, np.arange(len(e)), 256, free=np.arange(len(e), len(eta))) if e else 0.0
        assert np.isclose(got[k], want, rtol=2e-3, atol=1e-4), k
    assert abs(np.exp(got[9]) - 1 / 6) < 0.01
    assert rankings.rank_log_probability(table.limit(0), ["k"]).count() == 0
