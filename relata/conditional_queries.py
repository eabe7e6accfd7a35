"""Registered queries over the deterministic steps of the estimators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relata import datasets as d
from relata.functions import distributions
from relata.operators import conditionals as c
from relata.operators import design, dyads, regression
from relata.queries import DESIGN_SQL, PANEL_SQL, RESIDUAL_SQL, XX, _residuals, designed, query, r, rounded, trade_panel, with_

E_SQL = (PANEL_SQL, RESIDUAL_SQL, "ce AS (SELECT * FROM ee WHERE y IS NOT NULL)")


def _pairs(spark, sf_dir):
    x = _residuals(spark, sf_dir).where("y is not null")
    back = x.select("t", F.col("j").alias("i"), F.col("i").alias("j"), F.col("e").alias("e_back"))
    return x.join(back, ["t", "i", "j"]).where("i < j")


@query(with_(*E_SQL, select=f"SELECT t, 0.5 + count(*) AS shape, {r('0.5 + (sum(x * x + w * w) - 0.6 * sum(x * w)) / 0.91 / 2', 'rate')} FROM pa WHERE x IS NOT NULL AND w IS NOT NULL GROUP BY t").replace("0.5 + count(*)", "CAST(0.5 + count(*) AS DOUBLE)"))
def conditional_pair_scale(spark, sf_dir):
    return rounded(c.pair_scale(_pairs(spark, sf_dir), 0.3, by=["t"]))


@query(with_(*E_SQL, select=f"SELECT t, CAST(0.5 + count(*) / 2.0 AS DOUBLE) AS shape, {r('0.5 + sum(e * e) / 2', 'rate')} FROM ce GROUP BY t"))
def conditional_cell_scale(spark, sf_dir):
    return rounded(c.cell_scale(_residuals(spark, sf_dir).where("y is not null"), by=["t"]))


def _effects_sql(at: str) -> str:
    return with_(*E_SQL, select=f"SELECT {at} AS actor, {r('sum(e) / 0.8 / (count(*) / 0.8 + 1 / 0.4)', 'mean')}, {r('count(*) / 0.8 + 1 / 0.4', 'precision')} FROM ce GROUP BY {at}")


@query(_effects_sql("i"))
def conditional_row_effects(spark, sf_dir):
    return rounded(c.effects(_residuals(spark, sf_dir).where("y is not null"), "i", 0.8, 0.4))


@query(_effects_sql("j"))
def conditional_column_effects(spark, sf_dir):
    return rounded(c.effects(_residuals(spark, sf_dir).where("y is not null"), "j", 0.8, 0.4))


@query(with_(*E_SQL, "m AS (SELECT i AS actor, avg(e) AS a FROM ce GROUP BY i), n AS (SELECT j AS actor, avg(e) AS b FROM ce GROUP BY j)", select=f"SELECT CAST(4 + count(*) AS DOUBLE) AS df, {r('1 + sum(a * a)', 'saa')}, {r('sum(a * b)', 'sab')}, {r('1 + sum(b * b)', 'sbb')} FROM m JOIN n USING (actor)"))
def conditional_effect_covariance(spark, sf_dir):
    x = _residuals(spark, sf_dir).where("y is not null")
    means = lambda at: x.groupBy(F.col(at).alias("actor")).agg(F.avg("e").alias("effect"))
    return rounded(c.effect_covariance(means("i"), means("j")))


@query(with_(PANEL_SQL, DESIGN_SQL, """s AS (SELECT count(*) / 0.5 + 0.01 AS a, sum(same_dyad) / 0.5 AS b, sum(same_dyad * same_dyad) / 0.5 + 0.01 AS d, sum(y) / 0.5 AS u, sum(same_dyad * y) / 0.5 AS v FROM des WHERE y IS NOT NULL)""", select=f"SELECT 'intercept' AS name, {r('(d * u - b * v) / (a * d - b * b)', 'mean')}, {r('sqrt(d / (a * d - b * b))', 'sd')} FROM s UNION ALL SELECT 'same_dyad', {r('(a * v - b * u) / (a * d - b * b)', 'mean')}, {r('sqrt(a / (a * d - b * b))', 'sd')} FROM s"))
def conditional_coefficients(spark, sf_dir):
    x, _ = designed(spark, sf_dir)
    return rounded(c.coefficients(x, ["intercept", "same_dyad"], 0.5, 100.0))


FACTOR_SQL = "po AS (SELECT CAST(n_nationkey AS VARCHAR(9)) AS j, sin(n_nationkey) AS v1, cos(2 * n_nationkey) AS v2 FROM nation)"


def _plane(spark, sf_dir):
    k = F.col("n_nationkey")
    return d.read(spark, sf_dir, "nation").select(k.cast("string").alias("actor"), F.array(F.sin(k.cast("double")), F.cos(2 * k.cast("double"))).alias("u"))


@query(with_(*E_SQL, FACTOR_SQL, "s AS (SELECT i, 1 + sum(v1 * v1) / 0.8 AS p, sum(v1 * v2) / 0.8 AS q, 1 + sum(v2 * v2) / 0.8 AS w, sum(e * v1) / 0.8 AS l, sum(e * v2) / 0.8 AS m FROM ce JOIN po USING (j) GROUP BY i)", select=f"SELECT i, {r('(w * l - q * m) / (p * w - q * q)', 'mean_1')}, {r('(p * m - q * l) / (p * w - q * q)', 'mean_2')}, {r('p', 'p_11')}, {r('q', 'p_12')}, {r('w', 'p_22')} FROM s"))
def conditional_factors(spark, sf_dir):
    return rounded(c.factors(_residuals(spark, sf_dir).where("y is not null"), _plane(spark, sf_dir), 0.8))


@query(with_(*E_SQL, select=f"SELECT t, i, j, CASE WHEN y > 2 THEN 0.0::DOUBLE END AS low, CASE WHEN y <= 2 THEN 0.0::DOUBLE END AS high FROM ee"))
def latent_bounds_binary(spark, sf_dir):
    x = trade_panel(spark, sf_dir).withColumn("y", F.when(F.col("y").isNotNull(), (F.col("y") > 2).cast("double")))
    return c.binary_bounds(x).select("t", "i", "j", "low", "high")


@query(with_(*E_SQL, "lv AS (SELECT t, least(y, 4) AS y, max(z + sin(CAST(i AS INTEGER))) AS most, min(z + sin(CAST(i AS INTEGER))) AS least FROM ce GROUP BY 1, 2)", select=f"SELECT t, CAST(y AS DOUBLE) AS y, {r('max(most) OVER (PARTITION BY t ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 'low')}, {r('min(least) OVER (PARTITION BY t ORDER BY y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)', 'high')} FROM lv"))
def latent_bounds_ordinal(spark, sf_dir):
    x = _residuals(spark, sf_dir).where("y is not null").withColumn("y", F.least("y", F.lit(4.0))).withColumn("z", F.col("z") + F.sin(F.col("i").cast("double")))
    return rounded(c.ordinal_bounds(x))


CENSORED_SQL = "k AS (SELECT t, i, j, e, sin(e * 7 + CAST(j AS INTEGER)) AS z, row_number() OVER (PARTITION BY t, i ORDER BY y DESC, j) AS n, y > 0 AS is_named FROM ce), cb AS (SELECT t, i, j, z, CASE WHEN n <= 5 AND is_named THEN 6 - n ELSE 0 END AS y FROM k)"


def _nominated(spark, sf_dir, ranked: bool):
    x = _residuals(spark, sf_dir).where("y is not null")
    k = F.row_number().over(Window.partitionBy("t", "i").orderBy(F.desc("y"), "j"))
    rank = F.when((F.col("_k") <= 5) & (F.col("y") > 0), 6 - F.col("_k")).otherwise(0).cast("double")
    out = x.withColumn("_k", k).withColumn("z", F.sin(F.col("e") * 7 + F.col("j").cast("double")))
    return out.withColumn("y", rank if ranked else (rank > 0).cast("double")).select("t", "i", "j", "y", "z")


@query(with_(*E_SQL, CENSORED_SQL, "g AS (SELECT *, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) OVER w >= 5 AS complete, max(CASE WHEN y = 0 THEN z END) OVER w AS top, min(CASE WHEN y > 0 THEN z END) OVER w AS least FROM cb WINDOW w AS (PARTITION BY t, i))", select=f"SELECT t, i, j, {r('CASE WHEN y > 0 THEN greatest(0.0, top) END', 'low')}, {r('CASE WHEN y = 0 THEN CASE WHEN complete THEN least ELSE 0.0 END END', 'high')} FROM g"))
def latent_bounds_censored(spark, sf_dir):
    return rounded(c.censored_bounds(_nominated(spark, sf_dir, False), 5).select("t", "i", "j", "low", "high"))


@query(with_(*E_SQL, CENSORED_SQL, "g AS (SELECT *, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) OVER w >= 5 AS complete, max(CASE WHEN y = 0 THEN z END) OVER w AS top, min(CASE WHEN y > 0 THEN z END) OVER w AS least FROM cb WINDOW w AS (PARTITION BY t, i))", select=f"""SELECT t, i, j, {r("CASE WHEN y > 0 THEN greatest(0.0, top, (SELECT max(h.z) FROM cb h WHERE h.t = g.t AND h.i = g.i AND h.y > 0 AND h.y < g.y)) END", 'low')},
  {r("CASE WHEN y > 0 THEN (SELECT min(h.z) FROM cb h WHERE h.t = g.t AND h.i = g.i AND h.y > g.y) WHEN complete THEN least ELSE 0.0 END", 'high')} FROM g"""))
def latent_bounds_ranked(spark, sf_dir):
    return rounded(c.ranked_bounds(_nominated(spark, sf_dir, True), 5).select("t", "i", "j", "low", "high"))


STEP_SQL = (d.ACTIVITY_SQL, "l AS (SELECT i, j, t, ln(1 + abs(x)) AS x, lag(t) OVER w AS pt, ln(1 + abs(lag(x) OVER w)) AS px FROM activity WINDOW w AS (PARTITION BY i, j ORDER BY t)), st AS (SELECT i, j, t, x, px FROM l WHERE pt = t - 1 AND x IS NOT NULL AND px IS NOT NULL)")


def _steps(spark, sf_dir):
    a = d.activity(spark, sf_dir).withColumn("value", F.log1p(F.abs("x")))
    return dyads.transitions(a.where("value is not null"), ["i", "j"])


@query(with_(*STEP_SQL, select=f"SELECT {r('(sum(px * x) / 0.7 + 0.9 / 0.01) / (sum(px * px) / 0.7 + 1 / 0.01)', 'mean')}, {r('sum(px * px) / 0.7 + 1 / 0.01', 'precision')} FROM st"))
def conditional_autoregression(spark, sf_dir):
    return rounded(c.autoregression_conditional(_steps(spark, sf_dir), 0.7))


@query(with_(*STEP_SQL, select=f"SELECT CAST(2 + count(*) / 2.0 AS DOUBLE) AS shape, {r('1 + sum((x - 0.8 * px) * (x - 0.8 * px)) / 2', 'rate')} FROM st"))
def conditional_innovation_scale(spark, sf_dir):
    return rounded(c.innovation_scale(_steps(spark, sf_dir), 0.8))


WEIGHT_SQL = "we AS (SELECT *, 5 / (4 + (x - 0.8 * px) * (x - 0.8 * px) / 0.7) AS w FROM st)"


@query(with_(*STEP_SQL, WEIGHT_SQL, select=f"SELECT i, j, t, {r('w', 'weight')} FROM we"))
def heavy_tail_weights(spark, sf_dir):
    return rounded(c.heavy_tail_weights(_steps(spark, sf_dir), 0.8, 0.7, 4.0).select("i", "j", "t", "weight"))


@query(with_(*STEP_SQL, WEIGHT_SQL, select=f"SELECT {r('(sum(w * px * x) / 0.7 + 0.9 / 0.01) / (sum(w * px * px) / 0.7 + 1 / 0.01)', 'mean')}, {r('sum(w * px * px) / 0.7 + 1 / 0.01', 'precision')}, {r('1 + sum(w * (x - 0.8 * px) * (x - 0.8 * px)) / 2', 'rate')} FROM we"))
def conditional_heavy_tails(spark, sf_dir):
    """Coefficient and scale given the weights of a Student-t process."""
    steps = c.heavy_tail_weights(_steps(spark, sf_dir), 0.8, 0.7, 4.0)
    both = c.autoregression_conditional(steps, 0.7, weight=F.col("weight")).crossJoin(c.innovation_scale(steps, 0.8, weight=F.col("weight")).select("rate"))
    return rounded(both)


@query(with_(*STEP_SQL, "lo AS (SELECT *, ln(0.1 / 0.9) - 0.5 * ln(2.0) - x * x / 4 + 0.5 * ln(0.7) + (x - 0.8 * px) * (x - 0.8 * px) / 1.4 AS o FROM st)", select=f"SELECT i, j, t, {r('o', 'log_odds')}, {r('1 / (1 + exp(-o))', 'reset')} FROM lo"))
def reset_probabilities(spark, sf_dir):
    return rounded(c.reset_probability(_steps(spark, sf_dir), 0.8, 0.7, 2.0, 0.1).select("i", "j", "t", "log_odds", "reset"))


#: Paths of the values of users and types over the weeks of the table, absent weeks as 0.
FULL_SQL = (
    "wk AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS r FROM (SELECT DISTINCT t FROM activity)), "
    "fp AS (SELECT k.i, k.j, wk.r, coalesce(a.x, 0) / 47 AS x FROM (SELECT DISTINCT i, j FROM activity) k CROSS JOIN wk LEFT JOIN activity a ON a.i = k.i AND a.j = k.j AND a.t = wk.t), "
    "lg AS (SELECT *, lag(x) OVER w AS p1, lag(x, 2) OVER w AS p2 FROM fp WINDOW w AS (PARTITION BY i, j ORDER BY r))"
)


def _energy(spark, sf_dir, kind, rho=1.0):
    """x'Qx of each path under the prior's precision for as many periods as the table has."""
    a = d.activity(spark, sf_dir)
    weeks = a.select("t").distinct().withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t")) - 1)
    x = a.join(F.broadcast(weeks), "t").select("i", "j", "r", (F.col("x") / 47).alias("x"))
    prior = c.path_prior(kind, weeks.count(), rho, 0.5, spark=spark)
    return rounded(c.path_energy(x, prior, ["i", "j"]))


def _energy_sql(value: str) -> str:
    return with_(d.ACTIVITY_SQL, FULL_SQL, select=f"SELECT i, j, {r(value, 'energy')} FROM lg GROUP BY i, j")


@query(_energy_sql("(sum(CASE WHEN r = 0 THEN (1 - 0.81) * x * x ELSE 0 END) + coalesce(sum((x - 0.9 * p1) * (x - 0.9 * p1)), 0)) / 0.5"))
def path_prior_ar1(spark, sf_dir):
    return _energy(spark, sf_dir, "ar1", 0.9)


@query(_energy_sql("coalesce(sum((x - p1) * (x - p1)), 0) / 0.5 + 0.01 * sum(x * x)"))
def path_prior_rw1(spark, sf_dir):
    return _energy(spark, sf_dir, "rw1")


@query(_energy_sql("coalesce(sum((x - 2 * p1 + p2) * (x - 2 * p1 + p2)), 0) / 0.5 + 0.01 * sum(x * x)"))
def path_prior_rw2(spark, sf_dir):
    return _energy(spark, sf_dir, "rw2")


FILTER_SQL = """RECURSIVE src AS (SELECT i, t, dense_rank() OVER (ORDER BY t) AS k, count(e) AS n, coalesce(sum(e), 0) AS s FROM ce GROUP BY i, t),
f(i, k, m, v) AS (
  SELECT i, k, (s / 0.8) / (0.36 / 0.5 + n / 0.8), 1 / (0.36 / 0.5 + n / 0.8) FROM src WHERE k = 1
  UNION ALL SELECT x.i, x.k, (0.8 * f.m / (0.64 * f.v + 0.5) + x.s / 0.8) / (1 / (0.64 * f.v + 0.5) + x.n / 0.8), 1 / (1 / (0.64 * f.v + 0.5) + x.n / 0.8) FROM f JOIN src x ON x.i = f.i AND x.k = f.k + 1
),
b(i, k, m) AS (
  SELECT i, k, m FROM f WHERE k = (SELECT max(k) FROM src)
  UNION ALL SELECT f.i, f.k, f.m + 0.8 * f.v / (0.64 * f.v + 0.5) * (b.m - 0.8 * f.m) FROM b JOIN f ON f.i = b.i AND f.k = b.k - 1
)"""


@query("WITH RECURSIVE " + ", ".join(E_SQL) + ", " + FILTER_SQL.removeprefix("RECURSIVE ") + f"\nSELECT src.i, src.t, {r('f.m', 'filtered')}, {r('b.m', 'smoothed')}, {r('f.v', 'variance')} FROM src JOIN f USING (i, k) JOIN b USING (i, k)")
def filtered_effect_paths(spark, sf_dir):
    """Senders' moving effects: forward filter and backward means of AR(1) paths seen in noise."""
    return rounded(c.filtered_paths(_residuals(spark, sf_dir).where("y is not null"), ["i"], 0.8, 0.5, 0.8))


@query(with_(*E_SQL, "m AS (SELECT i AS actor, avg(e) AS v FROM ce GROUP BY i)", select=f"SELECT actor, CAST(h AS INTEGER) AS ahead, {r('pow(0.8, h) * v', 'mean')}, {r('0.5 * (1 - pow(0.64, h)) / 0.36', 'variance')} FROM m CROSS JOIN range(1, 5) g(h)"))
def forecast_effects(spark, sf_dir):
    x = _residuals(spark, sf_dir).where("y is not null").groupBy(F.col("i").alias("actor")).agg(F.avg("e").alias("value"))
    return rounded(c.propagated(x, 0.8, 0.5, 4).select("actor", "ahead", "mean", "variance"))


@query(with_(PANEL_SQL, DESIGN_SQL, select=f"SELECT t, i, j, {r('0.3 * intercept - 0.7 * same_dyad + 0.01 * w_nsupp_row + 0.0001 * w_acctbal_col', 'eta')} FROM des"))
def linear_predictor(spark, sf_dir):
    x, _ = designed(spark, sf_dir)
    return rounded(design.linear_predictor(x, dict(zip(XX, (0.3, -0.7, 0.01, 0.0001)))).select("t", "i", "j", "eta"))


MEANS_SQL = "ra AS (SELECT i, avg(e) AS a FROM ce GROUP BY i), rb AS (SELECT j, avg(e) AS b FROM ce GROUP BY j)"


@query(with_(*E_SQL, DESIGN_SQL, FACTOR_SQL, MEANS_SQL, select=f"SELECT x.t, x.i, x.j, {r('0.3 * intercept - 0.7 * same_dyad + coalesce(a, 0) + coalesce(b, 0) + p.v1 * q.v1 + p.v2 * q.v2', 'eta')} FROM des x LEFT JOIN ra ON ra.i = x.i LEFT JOIN rb ON rb.j = x.j JOIN po p ON p.j = x.i JOIN po q ON q.j = x.j"))
def expected_surface(spark, sf_dir):
    """Coefficients, additive effects and products of positions together."""
    x, _ = designed(spark, sf_dir)
    e = _residuals(spark, sf_dir).where("y is not null")
    means = lambda at: e.groupBy(F.col(at).alias("actor")).agg(F.avg("e").alias("effect"))
    return rounded(c.surface(x, {"intercept": 0.3, "same_dyad": -0.7}, means("i"), means("j"), _plane(spark, sf_dir)).select("t", "i", "j", "eta"))


@query(with_(*E_SQL, select=f"SELECT t, {r('-2 * sum(CASE WHEN y > 2 THEN ln(1 / (1 + exp(1 - eta))) ELSE ln(1 - 1 / (1 + exp(1 - eta))) END)', 'deviance')} FROM ce GROUP BY t"))
def deviance_binary(spark, sf_dir):
    x = _residuals(spark, sf_dir).where("y is not null")
    return rounded(x.groupBy("t").agg(dyads.binary_deviance((F.col("y") > 2).cast("double"), distributions.inverse_link("binary", F.col("eta") - 1, "logit")).alias("deviance")))


@query(with_(*E_SQL, select=f"SELECT t, i, j, {r('1 / (1 + exp(-e))', 'logit')}, {r('exp(e)', 'poisson')}, {r('e', 'normal')} FROM ce"))
def inverse_links(spark, sf_dir):
    x, e = _residuals(spark, sf_dir).where("y is not null"), F.col("e")
    links = distributions.inverse_link
    return rounded(x.select("t", "i", "j", links("binary", e, "logit").alias("logit"), links("poisson", e).alias("poisson"), links("normal", e).alias("normal")))


def _halton_sql(base: int) -> str:
    return r(f"list_sum(list_transform(range(0, 40), lambda p: CAST(CAST(floor((event_id + 31) / pow({base}, p)) AS BIGINT) % {base} AS DOUBLE) / pow({base}, p + 1)))", f"base{base}")


@query("SELECT event_id, " + ", ".join(_halton_sql(b) for b in (2, 3, 5)) + " FROM events")
def halton_points(spark, sf_dir):
    """A point of the low-discrepancy sequence for each event, by its number."""
    e = d.read(spark, sf_dir, "events")
    return rounded(e.select("event_id", *[distributions.radical_inverse(F.col("event_id") + 31, b).alias(f"base{b}") for b in (2, 3, 5)]))


@query(with_(*E_SQL, MEANS_SQL, select=f"SELECT t, i, j, {r('eta + a + b', 'fitted')}, {r('e - a - b', 'residual')} FROM ce JOIN ra USING (i) JOIN rb USING (j)"))
def additive_residuals(spark, sf_dir):
    """Fitted values and residuals of given effects."""
    e = _residuals(spark, sf_dir).where("y is not null")
    means = lambda at: e.groupBy(F.col(at).alias("actor")).agg(F.avg("e").alias("effect"))
    x = c.surface(e.withColumnRenamed("eta", "level"), {"level": 1.0}, means("i"), means("j"))
    return rounded(x.select("t", "i", "j", F.col("eta").alias("fitted"), (F.col("z") - F.col("eta")).alias("residual")))


@query(with_(PANEL_SQL, "s AS (SELECT CAST(count(DISTINCT i) AS INTEGER) AS n, CAST(count(DISTINCT j) AS INTEGER) AS m FROM cells), k AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS rank)", select="SELECT rank, CAST(4 + 1 + (n - 1) + (m - 1) + rank * (n + m - rank) AS INTEGER) AS directed, CAST(4 + 1 + (n - 1) + rank * n - rank * (rank - 1) // 2 AS INTEGER) AS symmetric FROM s CROSS JOIN k"))
def mean_parameters(spark, sf_dir):
    n = trade_panel(spark, sf_dir).where("y is not null").agg(F.countDistinct("i").cast("int").alias("n"), F.countDistinct("j").cast("int").alias("m"))
    f = regression.degrees_of_freedom
    rows = [F.struct(F.lit(k).alias("rank"), f(4, F.col("n"), F.col("m"), k, False).cast("int").alias("directed"), f(4, F.col("n"), None, k, True).cast("int").alias("symmetric")) for k in (0, 1, 2)]
    return n.select(F.inline(F.array(*rows)))
