"""Registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata import datasets as d
from relata.functions import links
from relata.operators import components, design, dyads, evaluation, regression, statistics, summaries
from relata.session import written
from relata.sources import edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Digits that floating-point results are compared at.
DIGITS = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles at so many digits, and no negative zeros."""
    return df.select(*[(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


def trade_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade on the full spine of nations and years: no trade is 0, the diagonal is null."""
    t = d.trade(spark, sf_dir)
    rows, _ = edges.actors_of(t, by_period=False)
    full = edges.edges_to_dyads(t, actors=rows)
    panel = full.withColumn("y", F.when(F.col("i") == F.col("j"), None).otherwise(F.col("y")))
    return written(panel, "panel")  # statistics read it several times, and it is small beside the items it counts


PANEL_SQL = (
    d.TRADE_SQL
    + """, actors AS (SELECT i AS a FROM trade UNION SELECT j FROM trade), periods AS (SELECT DISTINCT t FROM trade),
panel AS (
  SELECT p.t, x.a AS i, z.a AS j, CASE WHEN x.a = z.a THEN NULL ELSE coalesce(e.y, 0) END AS y
  FROM periods p CROSS JOIN actors x CROSS JOIN actors z LEFT JOIN trade e ON e.t = p.t AND e.i = x.a AND e.j = z.a
), cells AS (SELECT * FROM panel WHERE y IS NOT NULL)"""
)


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n" + select


def r(expr: str, name: str) -> str:
    return f"round({expr}, {DIGITS}) + 0.0 AS {name}"


TRIADS_SQL = """mo AS (SELECT t, avg(y) AS mu, stddev_samp(y) AS sd FROM cells GROUP BY t),
e AS (SELECT c.t, c.i, c.j, c.y - mo.mu AS e FROM cells c JOIN mo ON c.t = mo.t),
cyc AS (SELECT a.t, sum(a.e * b.e * c.e) / count(*) AS v FROM e a JOIN e b ON a.t = b.t AND a.j = b.i JOIN e c ON c.t = a.t AND c.i = b.j AND c.j = a.i GROUP BY a.t),
tra AS (SELECT a.t, sum(a.e * b.e * c.e) / count(*) AS v FROM e a JOIN e b ON a.t = b.t AND a.j = b.j JOIN e c ON c.t = a.t AND c.i = b.i AND c.j = a.i GROUP BY a.t),
sr AS (SELECT t, stddev_samp(m) AS v FROM (SELECT t, i, avg(y) AS m FROM cells GROUP BY t, i) GROUP BY t),
sc AS (SELECT t, stddev_samp(m) AS v FROM (SELECT t, j, avg(y) AS m FROM cells GROUP BY t, j) GROUP BY t),
dd AS (SELECT a.t, corr(a.y, b.y) AS v FROM cells a JOIN cells b ON a.t = b.t AND a.i = b.j AND a.j = b.i GROUP BY a.t)"""


@query(with_(PANEL_SQL, TRIADS_SQL, select=f"SELECT sr.t, {r('sr.v', 'sd_row')}, {r('sc.v', 'sd_col')}, {r('dd.v', 'dyad_dep')}, {r('cyc.v / (mo.sd ** 3)', 'cycle_dep')}, {r('tra.v / (mo.sd ** 3)', 'trans_dep')} FROM sr JOIN sc ON sr.t = sc.t JOIN dd ON dd.t = sr.t JOIN cyc ON cyc.t = sr.t JOIN tra ON tra.t = sr.t JOIN mo ON mo.t = sr.t"))
def network_statistics(spark, sf_dir):
    return rounded(statistics.unipartite_statistics(trade_panel(spark, sf_dir)))


@query(ORACLE_SQL["network_statistics"])
def network_statistics_dense(spark, sf_dir):
    """The same statistics with matrix products of blocks of actors."""
    return rounded(statistics.unipartite_statistics(trade_panel(spark, sf_dir), method="grid"))


PURCHASE_SPINE = """sp AS (
  SELECT a.i, b.j, CASE WHEN p.i IS NULL THEN 0.0 ELSE 1.0 END AS y FROM (SELECT DISTINCT i FROM purchases) a CROSS JOIN (SELECT DISTINCT j FROM purchases) b LEFT JOIN purchases p ON p.i = a.i AND p.j = b.j
)"""
FOUR_SQL = "pc AS (SELECT a.j AS a, b.j AS b, count(*) AS c FROM purchases a JOIN purchases b ON a.i = b.i AND a.j < b.j GROUP BY 1, 2)"


@query(with_(d.PURCHASES_SQL, FOUR_SQL, select=f"SELECT 0 AS t, CAST(sum(c * (c - 1) / 2) AS BIGINT) AS four_cycles, {r('sum(c * (c - 1) / 2) / count(*) FILTER (WHERE c >= 2)', 'clustering')} FROM pc"))
def bipartite_four_cycles(spark, sf_dir):
    return rounded(statistics.four_cycles(written(d.purchases(spark, sf_dir), "purchases"), side="col"))


@query(with_(d.PURCHASES_SQL, PURCHASE_SPINE, FOUR_SQL, select=f"SELECT 0 AS t, (SELECT {r('stddev_samp(m)', 'x')} FROM (SELECT avg(y) AS m FROM sp GROUP BY i)) AS sd_row, (SELECT {r('stddev_samp(m)', 'x')} FROM (SELECT avg(y) AS m FROM sp GROUP BY j)) AS sd_col, (SELECT CAST(sum(c * (c - 1) / 2) AS BIGINT) FROM pc) AS four_cycles"))
def bipartite_network_statistics(spark, sf_dir):
    p = written(d.purchases(spark, sf_dir), "purchases")
    return rounded(statistics.bipartite_statistics(p, absent=True))


@query(with_(d.PURCHASES_SQL, select="SELECT 0 AS t, i AS actor, 'row' AS side, count(*) AS degree, CAST(count(*) AS DOUBLE) AS total FROM purchases GROUP BY i UNION ALL SELECT 0, j, 'col', count(*), CAST(count(*) AS DOUBLE) FROM purchases GROUP BY j"))
def bipartite_degrees(spark, sf_dir):
    return statistics.degrees(written(d.purchases(spark, sf_dir), "purchases"))


@query(with_(PANEL_SQL, select="SELECT t, i AS actor, 'row' AS side, CAST(sum(CASE WHEN y <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS degree, coalesce(sum(y), 0) AS total FROM panel GROUP BY t, i UNION ALL SELECT t, j, 'col', CAST(sum(CASE WHEN y <> 0 THEN 1 ELSE 0 END) AS BIGINT), coalesce(sum(y), 0) FROM panel GROUP BY t, j"))
def panel_degrees(spark, sf_dir):
    return statistics.degrees(trade_panel(spark, sf_dir))


@query(with_(PANEL_SQL, select="SELECT t, i, j, y FROM panel"))
def edges_to_panel(spark, sf_dir):
    return trade_panel(spark, sf_dir)


@query(with_(d.TRADE_SQL, select="SELECT t, i, j, y FROM trade WHERE y <> 0"))
def panel_to_edges(spark, sf_dir):
    return edges.dyads_to_edges(edges.edges_to_dyads(d.trade(spark, sf_dir)))


@query(with_(PANEL_SQL, select="SELECT a.t, a.i, a.j, CASE WHEN a.i = a.j THEN NULL ELSE a.y + b.y END AS y FROM panel a JOIN panel b ON a.t = b.t AND a.i = b.j AND a.j = b.i"))
def undirected_panel(spark, sf_dir):
    t = d.trade(spark, sf_dir).where("i <> j")
    rows, _ = edges.actors_of(d.trade(spark, sf_dir), by_period=False)
    return edges.edges_to_dyads(t, directed=False, actors=rows)


@query(with_(PANEL_SQL, select=f"SELECT a.t, a.i, a.j, {r('(a.y + b.y) / 2', 'y')} FROM panel a JOIN panel b ON a.t = b.t AND a.i = b.j AND a.j = b.i"))
def symmetrized_panel(spark, sf_dir):
    return rounded(statistics.symmetrized(trade_panel(spark, sf_dir)))


ALIGN_SQL = """pr AS (SELECT DISTINCT t, i AS a FROM activity), pj AS (SELECT DISTINCT t, j AS a FROM activity)"""


@query(with_(d.ACTIVITY_SQL, ALIGN_SQL, select="""SELECT p.t, a.i, b.j, e.y, (x.a IS NOT NULL AND z.a IS NOT NULL) AS present
FROM (SELECT DISTINCT t FROM activity) p CROSS JOIN (SELECT DISTINCT i FROM activity) a CROSS JOIN (SELECT DISTINCT j FROM activity) b
LEFT JOIN activity e ON e.t = p.t AND e.i = a.i AND e.j = b.j LEFT JOIN pr x ON x.t = p.t AND x.a = a.i LEFT JOIN pj z ON z.t = p.t AND z.a = b.j"""))
def aligned_bipartite_panel(spark, sf_dir):
    return edges.align_panel(d.activity(spark, sf_dir).drop("x"), square=False)


@query(with_(PANEL_SQL, select="SELECT n.t, n.i, n.j, CASE WHEN n.i = n.j THEN NULL ELSE n.y END AS y FROM panel n JOIN (SELECT DISTINCT t, i AS a FROM trade) x ON x.t = n.t AND x.a = n.i JOIN (SELECT DISTINCT t, i AS a FROM trade) z ON z.t = n.t AND z.a = n.j"))
def panel_restricted_to_present(spark, sf_dir):
    sellers = d.trade(spark, sf_dir).select("t", F.col("i").alias("actor")).distinct()
    return edges.restrict_to_presence(trade_panel(spark, sf_dir), sellers)


@query(with_(d.ACTIVITY_SQL, select="SELECT i AS actor, t, CASE WHEN lag(t) OVER (PARTITION BY i ORDER BY t) = t - 1 THEN 1 ELSE 0 END AS stays FROM (SELECT DISTINCT i, t FROM activity)"))
def presence_transitions(spark, sf_dir):
    """1 where an actor was also present in the period before."""
    here = d.activity(spark, sf_dir).select(F.col("i").alias("actor"), "t").distinct()
    before = F.lag("t").over(Window.partitionBy("actor").orderBy("t"))
    return here.select("actor", "t", F.when(before == F.col("t") - 1, 1).otherwise(0).alias("stays"))


NODES_SQL = """nodes AS (
  SELECT CAST(n.n_nationkey AS VARCHAR(9)) AS actor, CAST(n.n_regionkey AS VARCHAR(9)) AS region, b.w AS w_acctbal, coalesce(s.w, 0.0) AS w_nsupp
  FROM nation n LEFT JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS w FROM customer GROUP BY 1) b ON b.k = n.n_nationkey
  LEFT JOIN (SELECT s_nationkey AS k, CAST(count(*) AS DOUBLE) AS w FROM supplier GROUP BY 1) s ON s.k = n.n_nationkey
)"""
NODE_PAIRS = "FROM nodes a CROSS JOIN nodes b"


@query(with_(NODES_SQL, select=f"SELECT a.actor AS i, b.actor AS j, CAST(CASE WHEN a.actor = b.actor THEN NULL WHEN a.region = b.region THEN 1 ELSE 0 END AS DOUBLE) AS value {NODE_PAIRS}"))
def node_match(spark, sf_dir):
    return design.nodal_pair(d.nations(spark, sf_dir), "region", "match")


@query(with_(NODES_SQL, select=f"SELECT a.actor AS i, b.actor AS j, {r('CASE WHEN a.actor = b.actor THEN NULL ELSE abs(a.w_acctbal - b.w_acctbal) END', 'value')} {NODE_PAIRS}"))
def node_absdiff(spark, sf_dir):
    return rounded(design.nodal_pair(d.nations(spark, sf_dir), "w_acctbal", "absdiff"))


@query(with_(NODES_SQL, select=f"SELECT a.actor AS i, b.actor AS j, l.region AS level, CASE WHEN a.actor = b.actor THEN NULL ELSE CAST(a.region = l.region AS DOUBLE) + CAST(b.region = l.region AS DOUBLE) END AS value {NODE_PAIRS} CROSS JOIN (SELECT DISTINCT region FROM nodes) l"))
def node_factor(spark, sf_dir):
    return design.nodal_pair(d.nations(spark, sf_dir), "region", "factor")


@query(with_(NODES_SQL, select=f"SELECT a.actor AS i, b.actor AS j, {r('CASE WHEN a.actor = b.actor THEN NULL ELSE a.w_nsupp + b.w_nsupp END', 'value')} {NODE_PAIRS}"))
def node_sum(spark, sf_dir):
    return rounded(design.nodal_pair(d.nations(spark, sf_dir), "w_nsupp", "sum"))


def designed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The trade panel with supplier counts of both sides, the same region, and an intercept; log(1 + y) as response."""
    nodes = d.nations(spark, sf_dir)
    same = design.nodal_pair(nodes, "region", "match", square=False).withColumnRenamed("value", "same")
    panel = trade_panel(spark, sf_dir).withColumn("y", F.log1p("y")).join(same, ["i", "j"])
    return design.design(panel, ["same"], nodes, ["w_nsupp"], ["w_acctbal"])


DESIGN_SQL = (
    NODES_SQL
    + """, des AS (
  SELECT p.t, p.i, p.j, CASE WHEN b.w_acctbal IS NULL THEN NULL ELSE ln(1 + p.y) END AS y, CAST(1 AS DOUBLE) AS intercept,
         CAST(CASE WHEN a.region = b.region THEN 1 ELSE 0 END AS DOUBLE) AS same_dyad, a.w_nsupp AS w_nsupp_row, coalesce(b.w_acctbal, 0) AS w_acctbal_col
  FROM panel p JOIN nodes a ON a.actor = p.i JOIN nodes b ON b.actor = p.j
)"""
)


@query(with_(PANEL_SQL, DESIGN_SQL, select=f"SELECT t, i, j, {r('y', 'y')}, intercept, same_dyad, w_nsupp_row, {r('w_acctbal_col', 'w_acctbal_col')} FROM des"))
def design_columns(spark, sf_dir):
    x, names = designed(spark, sf_dir)
    return rounded(x.select("t", "i", "j", "y", *names).select("t", "i", "j", "y", F.col("intercept"), "same_dyad", "w_nsupp_row", "w_acctbal_col"))


XX = ["intercept", "same_dyad", "w_nsupp_row", "w_acctbal_col"]


def _xx_sql(columns: list[str]) -> str:
    parts = [f"SELECT t, count(*) AS n_obs, '{a}' AS a, '{b}' AS b, round(sum({a} * {b}), 3) + 0.0 AS value FROM des WHERE y IS NOT NULL GROUP BY t" for a in columns for b in [*columns, "y"]]
    return " UNION ALL ".join(parts)


@query(with_(PANEL_SQL, DESIGN_SQL, select=_xx_sql(XX)))
def design_cross_products(spark, sf_dir):
    x, names = designed(spark, sf_dir)
    return rounded(design.cross_products(x, names), 3)


@query(with_(PANEL_SQL, DESIGN_SQL, select=" UNION ALL ".join(f"SELECT t, '{side}' AS side, {at} AS actor, '{n}' AS name, round(sum({n}), 3) + 0.0 AS value FROM des GROUP BY t, {at}" for side, at in (("row", "i"), ("col", "j")) for n in XX)))
def design_margins(spark, sf_dir):
    x, names = designed(spark, sf_dir)
    return rounded(design.margins(x, names).select("t", "side", "actor", "name", "value"), 3)


@query(with_(PANEL_SQL, select=f"SELECT t, {r('regr_slope(y, x)', 'slope')}, {r('regr_intercept(y, x)', 'intercept')} FROM (SELECT a.t, ln(1 + a.y) AS y, ln(1 + b.y) AS x FROM cells a JOIN cells b ON a.t = b.t AND a.i = b.j AND a.j = b.i) GROUP BY t"))
def period_least_squares(spark, sf_dir):
    """Each period's regression of log trade on the opposite flow, by normal equations."""
    both = statistics.transposed(trade_panel(spark, sf_dir)).select("t", "i", "j", F.log1p("y").alias("y"), F.log1p("y_back").alias("x"), F.lit(1.0).alias("one"))
    fits = regression.penalised_paths(both.where("y is not null"), ["one", "x"], 0.0)
    return rounded(spark.createDataFrame([(int(t), float(b[1]), float(b[0])) for t, b in fits.items()], "t int, slope double, intercept double"))


def _sweeps_sql(n: int) -> str:
    parts = ["m AS (SELECT avg(y) AS mu FROM c)", "b0 AS (SELECT DISTINCT j, 0.0 AS e FROM c)"]
    for k in range(1, n + 1):
        parts.append(f"a{k} AS (SELECT c.i, avg(c.y - m.mu - b.e) AS e FROM c CROSS JOIN m JOIN b{k - 1} b ON b.j = c.j GROUP BY c.i)")
        parts.append(f"b{k} AS (SELECT c.j, avg(c.y - m.mu - a.e) AS e FROM c CROSS JOIN m JOIN a{k} a ON a.i = c.i GROUP BY c.j)")
    return ", ".join(parts)


@query(with_(PANEL_SQL, "c AS (SELECT i, j, ln(1 + y) AS y FROM cells)", _sweeps_sql(5), select=f"SELECT i AS actor, 'row' AS side, {r('e', 'effect')} FROM a5 UNION ALL SELECT j, 'col', {r('e', 'effect')} FROM b5"))
def additive_effects(spark, sf_dir):
    a, b, _ = regression.additive_effects(trade_panel(spark, sf_dir).withColumn("y", F.log1p("y")), sweeps=5)
    return rounded(a.withColumn("side", F.lit("row")).unionByName(b.withColumn("side", F.lit("col"))))


@query(with_(d.TRADE_SQL, "e AS (SELECT DISTINCT t, least(CAST(i AS INTEGER), CAST(j AS INTEGER)) AS a, greatest(CAST(i AS INTEGER), CAST(j AS INTEGER)) AS b FROM trade WHERE i <> j AND y >= 1)", select="""SELECT n.a AS node, (SELECT min(m) FROM (
  WITH RECURSIVE walk(s, m) AS (SELECT n.a, n.a UNION SELECT w.s, CASE WHEN e.a = w.m THEN e.b ELSE e.a END FROM walk w JOIN e ON e.a = w.m OR e.b = w.m) SELECT m FROM walk)) AS root FROM (SELECT a FROM e UNION SELECT b FROM e) n WHERE n.a <> (SELECT min(m) FROM (
  WITH RECURSIVE walk(s, m) AS (SELECT n.a, n.a UNION SELECT w.s, CASE WHEN e.a = w.m THEN e.b ELSE e.a END FROM walk w JOIN e ON e.a = w.m OR e.b = w.m) SELECT m FROM walk))"""))
def connected_components(spark, sf_dir):
    t = d.trade(spark, sf_dir).where("i <> j and y >= 1").select(F.col("i").cast("int").alias("a"), F.col("j").cast("int").alias("b"))
    return components.star_components(t)


RANK_SQL = "rank() OVER (PARTITION BY t ORDER BY y) + (count(*) OVER (PARTITION BY t, y) - 1) / 2.0"


@query(with_(PANEL_SQL, select=f"SELECT t, i, j, {RANK_SQL} AS rank FROM cells"))
def average_ranks(spark, sf_dir):
    return trade_panel(spark, sf_dir).where("y is not null").select("t", "i", "j", design.average_rank("y", ["t"]).alias("rank"))


def _quantile_sql(p: str) -> str:
    """The rational approximation of the normal quantile, as text."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    e = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def horner(v, x):
        out = f"CAST({v[0]!r} AS DOUBLE)"
        for k in v[1:]:
            out = f"({out} * {x} + CAST({k!r} AS DOUBLE))"
        return out

    tail = lambda q: f"{horner(c, q)} / ({horner(e, q)} * {q} + 1.0)"
    lo, hi, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(lo)} WHEN {p} > 0.97575 THEN -({tail(hi)}) ELSE {horner(a, mid)} * ({p} - 0.5) / ({horner(b, mid)} * {mid} + 1.0) END"


@query(with_(PANEL_SQL, f"k AS (SELECT t, i, j, ({RANK_SQL}) / (1.0 + count(*) OVER (PARTITION BY t)) AS p FROM cells)", select=f"SELECT t, i, j, {r(_quantile_sql('p'), 'z')} FROM k"))
def normal_scores(spark, sf_dir):
    return rounded(design.normal_scores(trade_panel(spark, sf_dir), by=["t"]).where("y is not null").select("t", "i", "j", "z"))


@query(with_(PANEL_SQL, select=f"SELECT t, {r('avg(CASE WHEN y <> 0 THEN 1.0 ELSE 0.0 END)', 'value')} FROM panel GROUP BY t"))
def period_density(spark, sf_dir):
    return rounded(statistics.period_statistic(trade_panel(spark, sf_dir), "density"))


@query(with_(PANEL_SQL, select=f"SELECT a.t, {r('corr(a.y, b.y)', 'value')} FROM cells a JOIN cells b ON a.t = b.t AND a.i = b.j AND a.j = b.i AND a.i < a.j GROUP BY a.t"))
def period_reciprocity(spark, sf_dir):
    return rounded(statistics.period_statistic(trade_panel(spark, sf_dir), "reciprocity"))


@query(with_(PANEL_SQL, "ti AS (SELECT t, i, j FROM cells WHERE y <> 0 AND i <> j)", select=f"SELECT a.t, {r('avg(CASE WHEN c.i IS NULL THEN 0.0 ELSE 1.0 END)', 'value')} FROM ti a JOIN ti b ON a.t = b.t AND a.j = b.i AND a.i <> b.j LEFT JOIN ti c ON c.t = a.t AND c.i = a.i AND c.j = b.j GROUP BY a.t"))
def period_transitivity(spark, sf_dir):
    return rounded(statistics.period_statistic(trade_panel(spark, sf_dir), "transitivity"))


@query(with_(PANEL_SQL, select=f"SELECT {r('regr_slope(value, t)', 'slope')} FROM (SELECT t, avg(y) AS value FROM panel GROUP BY t)"))
def temporal_slope(spark, sf_dir):
    v = statistics.period_statistic(trade_panel(spark, sf_dir), "mean")
    return rounded(v.agg(F.regr_slope("value", F.col("t").cast("double")).alias("slope")))


P_SQL = "least(1.0, 2 * 0.3989422804014327 * exp(-(z * z) / 2) * (((((1.330274429 * k - 1.821255978) * k + 1.781477937) * k - 0.356563782) * k + 0.319381530) * k))"


@query(with_(d.DRAWS_SQL, "q AS (SELECT term, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM draws GROUP BY term), u AS (SELECT *, m / s AS z, 1 / (1 + 0.2316419 * abs(m / s)) AS k FROM q)", select=f"SELECT term, {r('m', 'estimate')}, {r('s', 'std_error')}, {r('z', 'statistic')}, {r(P_SQL, 'p_value')}, {r('lo', 'conf_low')}, {r('hi', 'conf_high')} FROM u"))
def tidy_draws(spark, sf_dir):
    return rounded(summaries.tidy(d.nested_draws(spark, sf_dir)))


@query(with_(d.DRAWS_SQL, select=" UNION ALL ".join(f"SELECT chain, CAST({p} AS DOUBLE) AS prob, {r(f'quantile_cont(value, {p})', 'value')} FROM draws GROUP BY chain" for p in (0.025, 0.5, 0.975))))
def draw_quantiles(spark, sf_dir):
    return rounded(summaries.quantiles(d.nested_draws(spark, sf_dir), by=("chain",)))


RHAT_SQL = "SELECT term, {x} AS rhat, count(*) AS chains FROM (SELECT {g}, avg(value) AS m, var_samp(value) AS v, CAST(count(*) AS DOUBLE) AS n FROM {f} GROUP BY {g}) GROUP BY term"
RHAT_EXPR = f"round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), {DIGITS})"


@query(with_(d.DRAWS_SQL, select=RHAT_SQL.format(x=RHAT_EXPR, g="term, chain", f="draws")))
def chain_rhat(spark, sf_dir):
    return rounded(summaries.rhat(d.nested_draws(spark, sf_dir)))


@query(with_(d.DRAWS_SQL, "h AS (SELECT *, count(*) OVER (PARTITION BY term, chain) // 2 AS half FROM draws), s AS (SELECT *, draw > half AS late FROM h WHERE draw <= 2 * half)", select=RHAT_SQL.format(x=RHAT_EXPR, g="term, chain, late", f="s")))
def split_rhat(spark, sf_dir):
    return rounded(summaries.rhat(d.nested_draws(spark, sf_dir), split=True))


@query(with_(d.ACTIVITY_SQL, "w AS (SELECT t, i AS draw, j, x FROM activity)", select=f"SELECT a.j AS term_a, b.j AS term_b, {r('covar_samp(a.x, b.x)', 'value')} FROM w a JOIN w b ON a.t = b.t AND a.draw = b.draw GROUP BY 1, 2"))
def draw_covariances(spark, sf_dir):
    a = d.activity(spark, sf_dir).select(F.col("t").alias("chain"), F.col("i").alias("draw"), F.col("j").alias("term"), F.col("x").alias("value"))
    return rounded(summaries.covariances(a))


LL_SQL = "ll AS (SELECT t, i AS draw, j AS i, '' AS j, -y / 10.0 AS ll FROM activity)"


@query(with_(d.ACTIVITY_SQL, LL_SQL, "m AS (SELECT t, i, max(ll) AS m FROM ll GROUP BY t, i), p AS (SELECT ll.t, ll.i, ln(avg(exp(ll.ll - m.m))) + min(m.m) AS lppd, var_samp(ll.ll) AS v FROM ll JOIN m ON m.t = ll.t AND m.i = ll.i GROUP BY ll.t, ll.i)", select=f"SELECT {r('sum(lppd - v)', 'elpd_waic')}, {r('sum(v)', 'p_waic')}, {r('-2 * sum(lppd - v)', 'waic')}, {r('2 * sqrt(count(*) * var_samp(lppd - v))', 'se')}, count(*) AS n_obs FROM p"))
def waic(spark, sf_dir):
    a = d.activity(spark, sf_dir).select("t", F.col("i").alias("draw"), F.col("j").alias("i"), F.lit("").alias("j"), (-F.col("y") / 10.0).alias("ll"))
    return rounded(summaries.waic(a))


PSIS_SQL = """lx AS (SELECT t, i AS draw, j AS i, -x / 50.0 AS ll FROM activity),
ws AS (SELECT t, i, -ll - max(-ll) OVER p AS w, min(ll) OVER p AS least, row_number() OVER (PARTITION BY t, i ORDER BY -ll, draw) AS rk, count(*) OVER p AS n FROM lx WINDOW p AS (PARTITION BY t, i)),
s AS MATERIALIZED (SELECT *, CAST(floor(least(0.2 * n, 3 * sqrt(n))) AS BIGINT) AS m FROM ws),
cut AS (SELECT t, i, exp(w) AS cut FROM s WHERE rk = n - m AND m >= 5),
xs AS MATERIALIZED (SELECT s.t, s.i, rk - (n - m) AS q, m, greatest(exp(w) - cut, 1e-300) AS x FROM s JOIN cut ON cut.t = s.t AND cut.i = s.i WHERE rk > n - m),
g AS (SELECT t, i, m, 30 + CAST(floor(sqrt(m)) AS BIGINT) AS gm, max(x) AS xl, max(x) FILTER (WHERE q = floor(m / 4.0 + 0.5)) AS xq FROM xs GROUP BY t, i, m HAVING max(x) > 1e-300),
th AS MATERIALIZED (SELECT t, i, m, j, 1 / xl + (1 - sqrt(gm / (j - 0.5))) / (3 * xq) AS th FROM (SELECT *, unnest(range(1, gm + 1)) AS j FROM g)),
sh AS (SELECT th.t, th.i, th.m, j, th, sum(ln(1 - th * x)) / th.m AS sh FROM th JOIN xs ON xs.t = th.t AND xs.i = th.i GROUP BY th.t, th.i, th.m, j, th),
pf AS MATERIALIZED (SELECT *, m * (ln(-th / sh) - sh - 1) AS p FROM sh),
wt AS (SELECT a.t, a.i, a.m, a.j, a.th, 1 / sum(exp(least(b.p - a.p, 700))) AS wt FROM pf a JOIN pf b ON a.t = b.t AND a.i = b.i GROUP BY a.t, a.i, a.m, a.j, a.th),
tt AS (SELECT t, i, m, sum(th * wt) / sum(wt) AS tt FROM wt GROUP BY t, i, m),
kk AS (SELECT tt.t, tt.i, tt.m, tt, sum(ln(1 - tt * x)) / tt.m AS k0 FROM tt JOIN xs ON xs.t = tt.t AND xs.i = tt.i GROUP BY tt.t, tt.i, tt.m, tt),
kf AS (SELECT t, i, (m * k0 + 5) / (m + 10) AS k, -k0 / tt AS sigma FROM kk),
sm AS (SELECT s.t, s.i, w, least, k, CASE WHEN k IS NOT NULL AND rk > n - m THEN least(ln(cut + sigma * (pow(1 - (rk - (n - m) - 0.5) / m, -k) - 1) / k), 0) ELSE w END AS a
  FROM s LEFT JOIN kf ON kf.t = s.t AND kf.i = s.i LEFT JOIN cut ON cut.t = s.t AND cut.i = s.i)"""


@query(with_(d.ACTIVITY_SQL, PSIS_SQL, select=f"SELECT t, i, {r('min(least) + ln(sum(exp(a - w))) - ln(sum(exp(a)))', 'elpd')}, {r('min(k)', 'k')} FROM sm GROUP BY t, i"))
def psis_loo(spark, sf_dir):
    """Smoothed leave-one-out densities, taking summed values of a week and type as draws of its log-likelihood."""
    ll = d.activity(spark, sf_dir).select("t", F.col("i").alias("draw"), F.col("j").alias("i"), (-F.col("x") / 50.0).alias("ll"))
    return rounded(summaries.psis_loo(ll, ("t", "i")))


ESS_SQL = """c AS MATERIALIZED (SELECT chain, draw, value - avg(value) OVER (PARTITION BY chain) AS c, count(*) OVER (PARTITION BY chain) AS n FROM draws),
acf AS (SELECT a.chain, b.draw - a.draw AS lag, sum(a.c * b.c) / count(*) AS v FROM c a JOIN c b ON a.chain = b.chain AND b.draw > a.draw GROUP BY 1, 2),
v0 AS (SELECT chain, n, avg(c * c) AS v FROM c GROUP BY chain, n),
pr AS (SELECT acf.chain, (lag + 1) // 2 AS p, sum(acf.v) / min(v0.v) AS rho FROM acf JOIN v0 ON v0.chain = acf.chain GROUP BY 1, 2 HAVING count(*) = 2),
st AS (SELECT chain, min(p) AS s FROM pr WHERE rho < 0 GROUP BY chain),
mo AS (SELECT pr.chain, min(rho) OVER (PARTITION BY pr.chain ORDER BY p) AS r FROM pr LEFT JOIN st ON st.chain = pr.chain WHERE s IS NULL OR p < s),
es AS (SELECT v0.chain, least(min(n), min(n) / greatest(1e-12, 1 + 2 * coalesce(sum(r), 0))) AS ess FROM v0 LEFT JOIN mo ON mo.chain = v0.chain GROUP BY v0.chain)"""


@query(with_(d.DRAWS_SQL, ESS_SQL, select=f"SELECT 'value' AS term, {r('sum(ess)', 'ess')} FROM es"))
def effective_sizes(spark, sf_dir):
    return rounded(summaries.effective_size(d.nested_draws(spark, sf_dir)))


SNAP_SQL = "ind AS (SELECT t AS year, i AS draw, j AS actor, CASE WHEN y > 3 THEN 1.0 ELSE 0.0 END AS value FROM activity), ix AS (SELECT draw, year, avg(value) AS index FROM ind GROUP BY draw, year)"


def _indicators(spark, sf_dir):
    return d.activity(spark, sf_dir).select(F.col("t").alias("year"), F.col("i").alias("draw"), F.col("j").alias("actor"), F.when(F.col("y") > 3, 1.0).otherwise(0.0).alias("value"))


@query(with_(d.ACTIVITY_SQL, SNAP_SQL, select="SELECT year, " + ", ".join([r("avg(index)", "mean"), r("stddev_samp(index)", "sd"), *(r(f"quantile_cont(index, {p})", n) for p, n in ((0.025, "q2_5"), (0.1, "q10"), (0.5, "q50"), (0.9, "q90"), (0.975, "q97_5")))]) + " FROM ix GROUP BY year"))
def snap_index_summary(spark, sf_dir):
    return rounded(summaries.snap_summary(_indicators(spark, sf_dir)))


@query(with_(d.ACTIVITY_SQL, SNAP_SQL, "rk AS (SELECT year, rank() OVER (PARTITION BY draw ORDER BY index DESC) AS k FROM ix)", select=f"SELECT year, {r('avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END)', 'p_first')}, {r('avg(CASE WHEN k <= 3 THEN 1.0 ELSE 0.0 END)', 'p_top')}, {r('avg(k)', 'mean_rank')}, {r('quantile_cont(k, 0.5)', 'median_rank')} FROM rk GROUP BY year"))
def snap_rank_summary(spark, sf_dir):
    return rounded(summaries.snap_ranks(_indicators(spark, sf_dir)))


@query(with_(d.ACTIVITY_SQL, "f AS (SELECT t, j, avg(x) AS m, stddev_samp(x) AS s FROM activity GROUP BY t, j), pl AS (SELECT j, sum(m / (s * s)) / sum(1 / (s * s)) AS pooled, sqrt(1 / sum(1 / (s * s))) AS se, var_samp(m) AS b, avg(s * s) AS w FROM f GROUP BY j)", select=f"SELECT f.t AS panel, f.j AS term, {r('m', 'estimate')}, {r('s', 'std_error')}, {r('pooled', 'pooled')}, {r('se', 'pooled_se')}, {r('m - pooled', 'deviation')}, {r('w / (w + coalesce(b, 0))', 'shrinkage')} FROM f JOIN pl ON f.j = pl.j"))
def pooled_panels(spark, sf_dir):
    f = d.activity(spark, sf_dir).groupBy(F.col("t").alias("panel"), F.col("j").alias("term")).agg(F.avg("x").alias("estimate"), F.stddev_samp("x").alias("std_error"))
    return rounded(summaries.pooled(f))


def _scored(spark, sf_dir):
    """Whether an order item was returned, and a made-up score, as a large set of held-out predictions."""
    l = d.read(spark, sf_dir, "lineitem")
    return l.select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), ((F.col("l_quantity") + 10 * F.col("l_discount") * 10) / 62.0).alias("predicted"))


SCORE_SQL = "s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, (l_quantity + 10 * l_discount * 10) / 62.0 AS p FROM lineitem), cl AS (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS q, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM s), st AS (SELECT p, sum(y) AS h, count(*) AS n FROM s GROUP BY p), cu AS (SELECT h, sum(h) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS pr FROM st)"


@query(with_(SCORE_SQL, select=f"SELECT {r('avg((y - p) * (y - p))', 'brier')}, {r('-avg(y * ln(q) + (1 - y) * ln(1 - q))', 'log_loss')}, {r('(sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y))', 'auroc')}, (SELECT {r('sum(h * pr) / sum(h)', 'x')} FROM cu) AS auprc FROM cl"))
def heldout_binary(spark, sf_dir):
    return rounded(evaluation.evaluate(_scored(spark, sf_dir), "binary"))


@query(f"WITH s AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem) SELECT round(sqrt(avg((y - p) * (y - p))), 4) + 0.0 AS rmse, round(avg(abs(y - p)), 4) + 0.0 AS mae, {r('-0.5 * ln(2 * pi() * avg((y - p) * (y - p))) - 0.5', 'log_density')} FROM s")
def heldout_normal(spark, sf_dir):
    s = d.read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("predicted"))
    e = evaluation.evaluate(s, "normal")
    return e.select((F.round("rmse", 4) + 0.0).alias("rmse"), (F.round("mae", 4) + 0.0).alias("mae"), (F.round("log_density", DIGITS) + 0.0).alias("log_density"))


@query(with_(d.ACTIVITY_SQL, "s AS (SELECT y, 5 + t AS p FROM activity)", select=f"SELECT {r('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {r('avg(y * ln(p) - p - lgamma(y + 1))', 'log_density')} FROM s"))
def heldout_poisson(spark, sf_dir):
    return rounded(evaluation.evaluate(d.activity(spark, sf_dir).select("y", (5 + F.col("t")).cast("double").alias("predicted")), "poisson"))


@query(with_(SCORE_SQL, select=f"SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, {r('avg(p)', 'mean_predicted')}, {r('avg(y)', 'mean_observed')} FROM s GROUP BY 1"))
def calibration_bins(spark, sf_dir):
    return rounded(evaluation.calibration(_scored(spark, sf_dir)))


@query(with_(d.DRAWS_SQL, "o AS (SELECT chain, avg(value) AS y FROM draws GROUP BY chain), pt AS (SELECT d.chain, avg(CASE WHEN d.value <= o.y THEN 1.0 ELSE 0.0 END) AS pit FROM draws d JOIN o ON d.chain = o.chain GROUP BY d.chain), k AS (SELECT *, row_number() OVER (ORDER BY pit) AS k, count(*) OVER () AS n FROM pt)", select=f"SELECT count(*) AS n, {r('avg(pit)', 'mean')}, {r('max(greatest(k / n - pit, pit - (k - 1) / n))', 'ks')}, {r('avg(CASE WHEN pit BETWEEN 0.05 AND 0.95 THEN 1.0 ELSE 0.0 END)', 'coverage')} FROM k"))
def pit_calibration(spark, sf_dir):
    draws = d.nested_draws(spark, sf_dir)
    return rounded(evaluation.pit_summary(evaluation.pit(draws, draws.groupBy("chain").agg(F.avg("value").alias("y")), by=("chain",))))


@query(with_("v AS (SELECT l_quantity AS value, l_extendedprice AS w FROM lineitem), c AS (SELECT value, sum(sum(w)) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(sum(w)) OVER () AS s FROM v GROUP BY value)", select=" UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS prob, min(value) AS value FROM c WHERE s >= {p} - 1e-12" for p in (0.1, 0.5, 0.9))))
def weighted_quantiles(spark, sf_dir):
    v = d.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("weight"))
    return summaries.weighted_quantile(v, (0.1, 0.5, 0.9))


# cells and pairs ------------------------------------------------------------------------------------


def _residuals(spark, sf_dir):
    """Log trade around its mean, as z and eta."""
    x = trade_panel(spark, sf_dir).withColumn("z", F.log1p("y"))
    return x.withColumn("eta", F.avg("z").over(Window.partitionBy("t"))).withColumn("e", F.col("z") - F.col("eta"))


RESIDUAL_SQL = "re AS (SELECT t, i, j, y, ln(1 + y) AS z, avg(ln(1 + y)) OVER (PARTITION BY t) AS eta FROM panel), ee AS (SELECT *, z - eta AS e FROM re), pa AS (SELECT a.t, a.i, a.j, a.e AS x, b.e AS w, a.y AS y1, b.y AS y2, a.z AS z1, b.z AS z2 FROM ee a JOIN ee b ON a.t = b.t AND a.i = b.j AND a.j = b.i AND a.i < a.j)"
PAIR_SQL = "-1.8378770664093453 - ln(0.5) - 0.5 * ln(1 - 0.09) - (x * x + w * w - 0.6 * x * w) / (0.5 * 0.91) / 2"


@query(with_(PANEL_SQL, RESIDUAL_SQL, select=f"SELECT t, i, j, {r(PAIR_SQL, 'log_density')} FROM pa"))
def pair_densities_normal(spark, sf_dir):
    return rounded(dyads.pair_log_density(_residuals(spark, sf_dir), 0.3, 0.5))


@query(with_(PANEL_SQL, RESIDUAL_SQL, select=f"SELECT t, i, j, {r(PAIR_SQL + ' + y1 * z1 - exp(z1) - lgamma(y1 + 1) + y2 * z2 - exp(z2) - lgamma(y2 + 1)', 'log_density')} FROM pa"))
def pair_densities_poisson(spark, sf_dir):
    return rounded(dyads.pair_log_density(_residuals(spark, sf_dir), 0.3, 0.5, "poisson"))


@query(with_(PANEL_SQL, RESIDUAL_SQL, "su AS (SELECT t, sum(x * x + w * w) AS s, sum(x * w) AS c, count(*) AS n FROM pa GROUP BY t), g AS (SELECT CAST(unnest([-0.5, 0.0, 0.5]) AS DOUBLE) AS rho)", select=f"SELECT t, rho, {r('-n * 1.8378770664093453 - 0.5 * n * ln(1 - rho * rho) - (s - 2 * rho * c) / (2 * (1 - rho * rho))', 'log_likelihood')} FROM su CROSS JOIN g"))
def reciprocity_likelihood(spark, sf_dir):
    return rounded(dyads.reciprocity_profile(_residuals(spark, sf_dir), (-0.5, 0.0, 0.5)))


@query(with_(PANEL_SQL, RESIDUAL_SQL, select=f"SELECT t, i, j, {r('eta + (y - exp(eta)) / exp(eta)', 'z')}, {r('exp(eta)', 'w')} FROM ee WHERE y IS NOT NULL"))
def irls_working_poisson(spark, sf_dir):
    z, w = links.working_columns(F.col("y"), F.col("eta"), "poisson")
    return rounded(_residuals(spark, sf_dir).where("y is not null").select("t", "i", "j", z.alias("z"), w.alias("w")))


@query(with_(PANEL_SQL, RESIDUAL_SQL, "lo AS (SELECT t, i, j, CASE WHEN y > 2 THEN 1.0 ELSE 0.0 END AS v, eta - 1 AS f, 1 / (1 + exp(-(eta - 1))) AS p FROM ee WHERE y IS NOT NULL)", select=f"SELECT t, i, j, {r('f + (v - p) / (p * (1 - p))', 'z')}, {r('p * (1 - p)', 'w')} FROM lo"))
def irls_working_logit(spark, sf_dir):
    z, w = links.working_columns(F.when(F.col("y") > 2, 1.0).otherwise(0.0), F.col("eta") - 1, "binary")
    return rounded(_residuals(spark, sf_dir).where("y is not null").select("t", "i", "j", z.alias("z"), w.alias("w")))


@query(with_(PANEL_SQL, RESIDUAL_SQL, select=f"SELECT t, {r('2 * sum(CASE WHEN y > 0 THEN y * ln(y / exp(eta)) ELSE 0 END - (y - exp(eta)))', 'deviance')} FROM ee WHERE y IS NOT NULL GROUP BY t"))
def deviance_poisson(spark, sf_dir):
    x = _residuals(spark, sf_dir).where("y is not null")
    return rounded(x.groupBy("t").agg(dyads.poisson_deviance(F.col("y"), F.exp("eta")).alias("deviance")))


def _positions(spark, sf_dir):
    """The mean vector of each label, over all vectors."""
    e = d.read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    mean = e.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(F.col("label").cast("string").alias("actor")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("u"))


POSITION_SQL = "lo AS (SELECT CAST(label AS VARCHAR(9)) AS actor, k, avg(CAST(embedding[k] AS DOUBLE)) AS x FROM embeddings, range(1, 65) g(k) GROUP BY 1, 2)"
SURFACE_SQL = "su AS (SELECT a.actor AS i, b.actor AS j, sum(a.x * b.x) AS v FROM lo a JOIN lo b ON a.k = b.k GROUP BY 1, 2)"


@query(with_(POSITION_SQL, SURFACE_SQL, select=f"SELECT i, j, {r('v', 'value')} FROM su"))
def product_surface(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return rounded(dyads.product_surface(p, p))


@query(with_(POSITION_SQL, select=f"SELECT CAST(a.k - 1 AS INTEGER) AS r, CAST(64 - b.k AS INTEGER) AS s, {r('sum(a.x * b.x)', 'value')} FROM lo a JOIN lo b ON a.actor = b.actor GROUP BY 1, 2"))
def position_cross_products(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return rounded(dyads.cross_product(p, p.withColumn("u", F.reverse("u"))))


@query(with_(POSITION_SQL, SURFACE_SQL, "ma AS (SELECT *, avg(v) OVER () AS m, avg(v) OVER (PARTITION BY i) AS ri, avg(v) OVER (PARTITION BY j) AS cj FROM su)", select=f"SELECT i, j, {r('v - ri - cj + m', 'value')}, {r('ri - m', 'row')}, {r('cj - m', 'col')}, {r('m', 'mean')} FROM ma"))
def centred_product_surface(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return rounded(dyads.centred_products(dyads.product_surface(p, p)))


@query(with_(d.ACTIVITY_SQL, "l AS (SELECT i, j, t, x, lag(t) OVER w AS pt, lag(x) OVER w AS px FROM activity WINDOW w AS (PARTITION BY i, j ORDER BY t))", select=f"SELECT i, j, t, {r('x', 'value')}, {r('px', 'before')} FROM l WHERE pt = t - 1"))
def path_transitions(spark, sf_dir):
    a = d.activity(spark, sf_dir).withColumnRenamed("x", "value")
    return rounded(dyads.transitions(a, ["i", "j"]))


@query(with_(PANEL_SQL, "k AS (SELECT t, i, j, y - 80 AS z, row_number() OVER (PARTITION BY t, i ORDER BY y DESC, j) AS k FROM cells), n AS (SELECT *, sum(CASE WHEN k <= 3 AND z > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY t, i) AS m FROM k)", select="SELECT t, i, j, CASE WHEN k <= 3 AND z > 0 THEN CAST(m - k + 1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y FROM n"))
def rank_nominations(spark, sf_dir):
    z = trade_panel(spark, sf_dir).where("y is not null").withColumn("z", F.col("y") - 80)
    return dyads.nominations(z.drop("y"), 3).select("t", "i", "j", "y")


@query(with_(PANEL_SQL, "q AS (SELECT t, quantile_cont(y, 0.3) AS a, quantile_cont(y, 0.8) AS b FROM cells GROUP BY t)", select="SELECT c.t, c.i, c.j, CAST((c.y > q.a)::INTEGER + (c.y > q.b)::INTEGER AS DOUBLE) AS y FROM cells c JOIN q ON q.t = c.t"))
def ordinal_levels(spark, sf_dir):
    z = trade_panel(spark, sf_dir).where("y is not null").withColumnRenamed("y", "z")
    return dyads.ordinal_cuts(z, (0.3, 0.8)).select("t", "i", "j", "y")


@query(with_(PANEL_SQL, RESIDUAL_SQL, "v AS (SELECT t, i, j, e FROM ee WHERE e IS NOT NULL), s AS (SELECT least(i, j) AS a, greatest(i, j) AS b, sum(e) AS s1, sum(e * z) AS s2 FROM (SELECT v.*, ee.z FROM v JOIN ee ON ee.t = v.t AND ee.i = v.i AND ee.j = v.j) GROUP BY 1, 2), n AS (SELECT count(*) AS n, sum(z) AS sz, sum(z * z) AS szz FROM ee WHERE e IS NOT NULL), me AS (SELECT sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22 FROM s), iv AS (SELECT szz / (n * szz - sz * sz) AS b11, -sz / (n * szz - sz * sz) AS b12, n / (n * szz - sz * sz) AS b22 FROM n)", select=f"SELECT {r('1000 * (b11 * b11 * m11 + 2 * b11 * b12 * m12 + b12 * b12 * m22)', 'v11')}, {r('1000 * (b11 * b12 * m11 + (b11 * b22 + b12 * b12) * m12 + b12 * b22 * m22)', 'v12')}, {r('1000 * (b12 * b12 * m11 + 2 * b12 * b22 * m12 + b22 * b22 * m22)', 'v22')} FROM me CROSS JOIN iv"))
def clustered_sandwich(spark, sf_dir):
    """Covariance (times 1000) of an intercept and log trade from residual scores summed per pair."""
    x = _residuals(spark, sf_dir).withColumn("one", F.lit(1.0)).withColumn("residual", F.col("e")).where("e is not null")
    v = regression.sandwich(x, ["one", "z"]) * 1000
    return rounded(spark.createDataFrame([(float(v[0, 0]), float(v[0, 1]), float(v[1, 1]))], "v11 double, v12 double, v22 double"))


@query(with_(PANEL_SQL, RESIDUAL_SQL, "ra AS (SELECT i AS actor, avg(e) AS a FROM ee GROUP BY i), rb AS (SELECT j AS actor, avg(e) AS b FROM ee GROUP BY j)", select=f"SELECT {r('(SELECT var_samp(a) FROM ra)', 'va')}, {r('(SELECT covar_samp(a, b) FROM ra JOIN rb ON ra.actor = rb.actor)', 'cab')}, {r('(SELECT var_samp(b) FROM rb)', 'vb')}, {r('(SELECT corr(a.e, b.e) FROM ee a JOIN ee b ON a.t = b.t AND a.i = b.j AND a.j = b.i AND a.i <> a.j)', 'rho')}, {r('(SELECT avg(e * e) FROM ee WHERE i <> j)', 've')}"))
def variance_components(spark, sf_dir):
    x = _residuals(spark, sf_dir).withColumnRenamed("e", "residual")
    a, b = (x.groupBy(F.col(c).alias("actor")).agg(F.avg("residual").alias("effect")) for c in ("i", "j"))
    return rounded(regression.variance_components(x, a, b))


@query(with_(d.ACTIVITY_SQL, SNAP_SQL, "g AS (SELECT i.*, CASE WHEN actor < 'd' THEN 'early' ELSE 'late' END AS grp FROM ind i), ig AS (SELECT draw, grp, year, avg(value) AS index FROM g GROUP BY 1, 2, 3)", select="SELECT grp AS \"group\", year, " + ", ".join([r("avg(index)", "mean"), r("stddev_samp(index)", "sd"), *(r(f"quantile_cont(index, {p})", n) for p, n in ((0.5, "q50"),))]) + " FROM ig GROUP BY 1, 2"))
def snap_group_summary(spark, sf_dir):
    ind = _indicators(spark, sf_dir)
    groups = ind.select("actor").distinct().withColumn("group", F.when(F.col("actor") < "d", "early").otherwise("late"))
    return rounded(summaries.snap_groups(ind, groups, probs=(0.5,)))


@query(with_(PANEL_SQL, select=f"SELECT t, max(y) AS top, {r('avg(y)', 'mean')}, {r('stddev_samp(y)', 'spread')} FROM panel GROUP BY t"))
def custom_statistics(spark, sf_dir):
    """User statistics given as aggregates."""
    return rounded(statistics.custom_statistics(trade_panel(spark, sf_dir), {"top": F.max("y"), "mean": F.avg("y"), "spread": F.stddev_samp("y")}))


@query(with_(PANEL_SQL, DESIGN_SQL, select=" UNION ALL ".join(f"SELECT t, i, j, '{n}' AS name, {r(n, 'value')} FROM des" for n in XX)))
def covariates_long(spark, sf_dir):
    x, names = designed(spark, sf_dir)
    return rounded(edges.long_covariates(x.select("t", "i", "j", *names), names))


BINARY_SQL = f"bi AS (SELECT t, i, j, CASE WHEN y > 85 THEN 1 ELSE 0 END AS y FROM cells), sc AS (SELECT t, i, j, y, ({RANK_SQL}) / (1.0 + count(*) OVER (PARTITION BY t)) AS p FROM bi), zs AS (SELECT t, i, j, y, {_quantile_sql('p')} AS z FROM sc), sh AS (SELECT t, coalesce((max(CASE WHEN y = 0 THEN z END) + min(CASE WHEN y = 1 THEN z END)) / 2, 0) AS s FROM zs GROUP BY t)"


@query(with_(PANEL_SQL, BINARY_SQL, select=f"SELECT zs.t, i, j, {r('z - s', 'z')} FROM zs JOIN sh ON sh.t = zs.t"))
def working_response_binary(spark, sf_dir):
    x = trade_panel(spark, sf_dir).where("y is not null").withColumn("y", (F.col("y") > 85).cast("int"))
    return rounded(design.working_response(x, "binary").select("t", "i", "j", "z"))


@query(with_(PANEL_SQL, "l AS (SELECT t, i, j, ln(1 + y) AS z FROM panel)", select=f"SELECT t, i, j, {r('coalesce(z, avg(z) OVER (PARTITION BY t) + avg(z) OVER (PARTITION BY t, i) + avg(z) OVER (PARTITION BY t, j))', 'z')} FROM l"))
def start_values(spark, sf_dir):
    """Start values of a Poisson sampler; unobserved cells get the mean plus their row's and column's."""
    return rounded(design.start_values(trade_panel(spark, sf_dir), "poisson").select("t", "i", "j", "z"))


@query(with_(d.ACTIVITY_SQL, "l AS (SELECT t, x, lag(t) OVER w AS pt, lag(x) OVER w AS px FROM activity WINDOW w AS (PARTITION BY i, j ORDER BY t))", select=f"SELECT {r('sum(x * px) / sum(px * px)', 'rho')} FROM l WHERE pt = t - 1"))
def path_autoregression(spark, sf_dir):
    rho = dyads.autoregression(d.activity(spark, sf_dir).withColumnRenamed("x", "value"), ["i", "j"])
    return rounded(spark.createDataFrame([(rho,)], "rho double"))


def _steps_sql(name: str, value: str) -> str:
    return f"{name}d AS (SELECT j AS term, i, abs({value} - lag({value}) OVER (PARTITION BY j, i ORDER BY t)) AS step, stddev_samp({value}) OVER (PARTITION BY j, i) AS sd FROM activity), {name} AS (SELECT term, i, max(step / CASE WHEN sd > 0 THEN sd END) AS largest FROM {name}d WHERE step IS NOT NULL GROUP BY term, i)"


@query(with_(d.ACTIVITY_SQL, _steps_sql("pa", "x"), _steps_sql("pr", "y"), "ba AS (SELECT term, quantile_cont(largest, 0.95) AS bar FROM pr GROUP BY term)", select=f"SELECT pa.term, {r('avg(CASE WHEN largest > bar THEN 1.0 WHEN largest <= bar THEN 0.0 END) / 0.05', 'bayes_factor')}, {r('avg(largest)', 'mean_largest')} FROM pa JOIN ba ON pa.term = ba.term GROUP BY pa.term"))
def change_points(spark, sf_dir):
    """Largest steps of summed-value paths against those of count paths as their prior."""
    a = d.activity(spark, sf_dir).select(F.col("j").alias("term"), F.lit(0).alias("chain"), F.col("i").alias("draw"), "t", "x", "y")
    found = summaries.change_points(a.withColumnRenamed("x", "value"), a.withColumnRenamed("y", "value"))
    return rounded(found.select("term", "bayes_factor", "mean_largest"))


@query(with_(PANEL_SQL, "m AS (SELECT t, avg(y) AS v FROM panel GROUP BY t), ob AS (SELECT regr_slope(v, t) AS s, count(*) AS n FROM m), rp AS (SELECT k, regr_slope(v * (1 + (k - 1.5) / 10), t) AS s FROM m CROSS JOIN range(4) g(k) GROUP BY k)", select=f"SELECT {r('(SELECT s FROM ob)', 'slope')}, {r('least(1.0, 2 * least(avg(CASE WHEN s >= (SELECT s FROM ob) THEN 1.0 ELSE 0.0 END), avg(CASE WHEN s <= (SELECT s FROM ob) THEN 1.0 ELSE 0.0 END)))', 'p')}, count(*) AS n_rep, {r('stddev_samp(s)', 'slope_sd')} FROM rp"))
def temporal_trend(spark, sf_dir):
    """The slope of mean trade against replicated panels with scaled values."""
    x = trade_panel(spark, sf_dir)
    reps = x.crossJoin(spark.range(4).withColumnRenamed("id", "rep")).withColumn("y", F.col("y") * (1 + (F.col("rep") - 1.5) / 10))
    return rounded(statistics.temporal_trend(x, reps, "mean"))


def _additive_sql(sweeps: int) -> str:
    """Alternating means of a two-way table with centred effects."""
    parts = ["c AS (SELECT i, j, ln(1 + y) AS y FROM cells)", "b0 AS (SELECT DISTINCT j, 0.0 AS e FROM c)", "m0 AS (SELECT avg(y) AS mu FROM c)"]
    for k in range(1, sweeps + 1):
        parts.append(f"a{k}r AS (SELECT c.i, avg(c.y - m.mu - b.e) AS e FROM c CROSS JOIN m{k - 1} m JOIN b{k - 1} b ON b.j = c.j GROUP BY c.i), a{k} AS (SELECT i, e - avg(e) OVER () AS e FROM a{k}r)")
        parts.append(f"b{k}r AS (SELECT c.j, avg(c.y - m.mu - a.e) AS e FROM c CROSS JOIN m{k - 1} m JOIN a{k} a ON a.i = c.i GROUP BY c.j), b{k} AS (SELECT j, e - avg(e) OVER () AS e FROM b{k}r)")
        parts.append(f"m{k} AS (SELECT avg(c.y - a.e - b.e) AS mu FROM c JOIN a{k} a ON a.i = c.i JOIN b{k} b ON b.j = c.j)")
    return ", ".join(parts)


@query(with_(PANEL_SQL, _additive_sql(8), select="SELECT i AS actor, 'row' AS side, round(e, 5) + 0.0 AS effect FROM a8 UNION ALL SELECT j, 'col', round(e, 5) + 0.0 FROM b8"))
def distributed_additive_fit(spark, sf_dir):
    """The additive fit whose every block is an aggregation."""
    from relata.plans.distributed import additive_fit

    x = trade_panel(spark, sf_dir).withColumn("y", F.log1p("y")).withColumn("intercept", F.lit(1.0))
    fit = additive_fit(x, ["intercept"], 8, 0.0)
    return rounded(fit.rows.withColumn("side", F.lit("row")).unionByName(fit.columns.withColumn("side", F.lit("col"))), 5)


# fits: stochastic or iterative, so without SQL; tests compare them with known parameters -----------


def _trade_data(spark, sf_dir):
    from relata.plans import models as m

    x, names = designed(spark, sf_dir)
    return m.Data(x.select("t", "i", "j", "y", *names), names)


@query()
def fit_point_estimate(spark, sf_dir):
    """Static point estimate of the trade panel with two factors: coefficients with clustered errors."""
    from relata.plans import models as m

    return m.point_fit(_trade_data(spark, sf_dir), rank=2).tidy()


@query()
def fit_moving_point_estimate(spark, sf_dir):
    """Point estimate with moving effects, coefficients and factors."""
    from relata.plans import models as m

    return m.point_fit(_trade_data(spark, sf_dir), rank=1, dynamic_ab=True, dynamic_beta=True, dynamic_uv="ar1").coef()


@query()
def fit_snap_point_estimate(spark, sf_dir):
    """Actor-years by the chance that their position was reset."""
    from relata.plans import models as m

    return m.point_fit(_trade_data(spark, sf_dir), rank=1, dynamic_uv="snap", max_iter=50).snap_changes()


@query()
def fit_bootstrap(spark, sf_dir):
    from relata.plans import models as m

    return m.point_fit(_trade_data(spark, sf_dir)).bootstrap().bootstrap_interval()


@query()
def fit_sampled(spark, sf_dir):
    """Two chains for the trade panel with two factors: summary with R-hat and effective draws."""
    from relata.plans import models as m

    return m.sampled_fit(_trade_data(spark, sf_dir), n_chains=2, rank=2).summary()


@query()
def fit_goodness(spark, sf_dir):
    """Observed statistics against those of simulated networks."""
    from relata.plans import models as m

    return m.sampled_fit(_trade_data(spark, sf_dir)).gof()


@query()
def fit_forecast(spark, sf_dir):
    """Two years ahead under moving effects and coefficients."""
    from relata.plans import models as m

    return m.sampled_fit(_trade_data(spark, sf_dir), dynamic_ab=True, dynamic_beta=True, keep_gof=False).forecast(2)


@query()
def fit_binary_bipartite(spark, sf_dir):
    """A probit model of whether a nation's customers bought from another's suppliers at least the median, as two modes."""
    from relata.plans import models as m

    x, names = designed(spark, sf_dir)
    one = x.withColumn("j", F.concat(F.lit("to "), "j"))
    bar = one.agg(F.percentile("y", 0.5)).first()[0]
    data = m.Data(one.withColumn("y", (F.col("y") >= bar).cast("double")).select("t", "i", "j", "y", *names), names, square=False)
    return m.sampled_fit(data, family="binary", rank=1).tidy()


@query()
def fit_leave_future_out(spark, sf_dir):
    from relata.plans import models as m
    from relata.plans.gibbs import Options

    return m.leave_future_out(_trade_data(spark, sf_dir), Options())


@query()
def fit_prior_paths(spark, sf_dir):
    """What coefficient paths of the prior look like over the panel's periods."""
    from relata.plans import models as m

    return m.prior_summary(spark, trade_panel(spark, sf_dir).select("t").distinct().count(), 500)
