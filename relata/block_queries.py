"""Queries of the distributed fits, with their steps written out as SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from relata import datasets as d
from relata.operators import dyads, rankings
from relata.operators.bootstrap import bootstrap_draws, bootstrap_intervals
from relata.plans.blocks import BlockFit, block_fit
from relata.queries import _quantile_sql, query, rounded, with_
from relata.session import scratch_path
from relata.sources.draws import pack, unpack

#: Digits of the results, after several sweeps of sums in other orders.
FIT_DIGITS = 5


def _round(expr: str, name: str) -> str:
    return f"round({expr}, {FIT_DIGITS}) + 0.0 AS {name}"


def _coefficients_sql(name: str, base: str, source: str) -> str:
    """Weighted least squares of z - base on 1 and x, two by two."""
    return (
        f"{name}s AS MATERIALIZED (SELECT sum(w) AS n, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * (z - {base})) AS sy, sum(w * x * (z - {base})) AS sxy FROM {source}), "
        f"{name} AS MATERIALIZED (SELECT (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM {name}s)"
    )


def _sweep_sql(k: str, source: str, state: tuple[str, str, str], rank: int, ridge: float) -> tuple[list[str], tuple[str, str, str]]:
    """One sweep on (i, j, x, z, w): senders, receivers, coefficients; a state names the tables of coefficients, senders and receivers."""
    beta, rows, columns = state
    parts = []
    for own, other, table in (("i", "j", columns), ("j", "i", f"r{k}")):
        name = f"{'r' if own == 'i' else 'c'}{k}"
        parts.append(
            f"{name}q AS MATERIALIZED (SELECT c.{own} AS actor, sum(w) AS s0, sum(w * o.f) AS s1, sum(w * o.f * o.f) + {ridge} AS s2, sum(w * (z - b0 - b1 * x - o.e)) AS r0, sum(w * o.f * (z - b0 - b1 * x - o.e)) AS r1 "
            f"FROM {source} c CROSS JOIN {beta} JOIN {table} o ON o.actor = c.{other} GROUP BY 1)"
        )
        solved = "(s2 * r0 - s1 * r1) / (s0 * s2 - s1 * s1) AS e, (s0 * r1 - s1 * r0) / (s0 * s2 - s1 * s1) AS f" if rank else "r0 / s0 AS e, CAST(0 AS DOUBLE) AS f"
        parts.append(f"{name}u AS MATERIALIZED (SELECT actor, {solved} FROM {name}q), {name} AS MATERIALIZED (SELECT actor, e - avg(e) OVER () AS e, f FROM {name}u)")
    parts.append(f"e{k} AS MATERIALIZED (SELECT c.*, a.e + b.e + a.f * b.f AS base FROM {source} c JOIN r{k} a ON a.actor = c.i JOIN c{k} b ON b.actor = c.j)")
    parts.append(_coefficients_sql(f"b{k}", "base", f"e{k}"))
    return parts, (f"b{k}", f"r{k}", f"c{k}")


def _start_sql(rank: int, seed: int = 29) -> list[str]:
    factor = f"CAST(CAST('0x' || substr(md5('{seed}:0:' || j), 1, 8) AS BIGINT) AS DOUBLE) / 2147483648 - 1" if rank else "CAST(0 AS DOUBLE)"
    return [
        "r0 AS MATERIALIZED (SELECT DISTINCT i AS actor, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS f FROM seen)",
        f"c0 AS MATERIALIZED (SELECT DISTINCT j AS actor, CAST(0 AS DOUBLE) AS e, {factor} AS f FROM seen)",
    ]


def _result_sql(state: tuple[str, str, str]) -> str:
    """Both sides' effects, and factors of equal length on both sides, with the sign that makes the scale positive."""
    beta, rows, columns = state
    lengths = f"(SELECT sqrt(sum(f * f)) FROM {rows}) AS lr, (SELECT sqrt(sum(f * f)) FROM {columns}) AS lc"
    return (
        f"SELECT 'row' AS side, actor, {_round('e', 'effect')}, {_round('CASE WHEN lr > 0 AND lc > 0 THEN f * sqrt(lc / lr) ELSE 0 END', 'factor')} FROM {rows} CROSS JOIN (SELECT {lengths}) "
        f"UNION ALL SELECT 'col', actor, {_round('e', 'effect')}, {_round('CASE WHEN lr > 0 AND lc > 0 THEN f * sqrt(lr / lc) ELSE 0 END', 'factor')} FROM {columns} CROSS JOIN (SELECT {lengths}) "
        f"UNION ALL SELECT 'coefficient', 'intercept', {_round('b0', 'effect')}, CAST(0 AS DOUBLE) AS factor FROM {beta} UNION ALL SELECT 'coefficient', 'x', {_round('b1', 'effect')}, CAST(0 AS DOUBLE) AS factor FROM {beta}"
    )


def normal_sql(sweeps: int, rank: int, ridge: float) -> str:
    parts = [d.SPENDING_SQL, "seen AS MATERIALIZED (SELECT i, j, discount AS x, ln(price) AS z, CAST(1 AS DOUBLE) AS w FROM spending)", *_start_sql(rank), _coefficients_sql("b0", "0", "seen")]
    state = ("b0", "r0", "c0")
    for k in range(1, sweeps + 1):
        more, state = _sweep_sql(str(k), "seen", state, rank, ridge)
        parts += more
    return with_(*parts, select=_result_sql(state))


def reweighted_sql(family: str, response: str, steps: int, sweeps: int) -> str:
    """Reweighted sweeps without factors, of which no step overshoots."""
    link = "ln((y + m) / 2)" if family == "poisson" else "ln((y + m) / 2 / (1 - (y + m) / 2))"
    work = {"poisson": "eta + (y - exp(eta)) / exp(eta) AS z, exp(eta) AS w", "binary": "eta + (y - 1 / (1 + exp(-eta))) * (1 + exp(-eta)) * (1 + exp(eta)) AS z, 1 / ((1 + exp(-eta)) * (1 + exp(eta))) AS w"}[family]
    begin = "ln(avg(y))" if family == "poisson" else "ln(avg(y) / (1 - avg(y)))"
    parts = [d.SPENDING_SQL, f"seen AS MATERIALIZED (SELECT i, j, discount AS x, {response} AS y FROM spending)", *_start_sql(0), f"b0 AS MATERIALIZED (SELECT {begin} AS b0, CAST(0 AS DOUBLE) AS b1 FROM seen)"]
    parts.append(f"h0 AS (SELECT i, j, x, y, {link} AS eta FROM seen CROSS JOIN (SELECT avg(y) AS m FROM seen))")
    state, eta = ("b0", "r0", "c0"), "h0"
    for n in range(steps):
        parts.append(f"w{n} AS MATERIALIZED (SELECT i, j, x, y, {work} FROM {eta})")
        for k in range(sweeps):
            more, state = _sweep_sql(f"{n}_{k + 1}", f"w{n}", state, 0, 0.0)
            parts += more
        eta = f"h{n + 1}"
        parts.append(f"{eta} AS (SELECT c.i, c.j, c.x, c.y, b0 + b1 * x + a.e + b.e AS eta FROM w{n} c CROSS JOIN {state[0]} JOIN {state[1]} a ON a.actor = c.i JOIN {state[2]} b ON b.actor = c.j)")
    return with_(*parts, select=_result_sql(state))


def _long(fit: BlockFit, spark):
    factor = F.coalesce(F.get("position", F.lit(0)), F.lit(0.0)).alias("factor")
    side = lambda t, name: t.select(F.lit(name).alias("side"), "actor", "effect", factor)
    coefficients = spark.createDataFrame([("coefficient", k, v, 0.0) for k, v in fit.beta.items()], "side string, actor string, effect double, factor double")
    return rounded(side(fit.rows, "row").unionByName(side(fit.columns, "col")).unionByName(coefficients), FIT_DIGITS)


def _cells(spark, sf_dir, y):
    return d.spending(spark, sf_dir).select("i", "j", y.alias("y"), F.lit(1.0).alias("intercept"), F.col("discount").alias("x"))


@query(normal_sql(2, 1, 1.0))
def distributed_lowrank_fit(spark, sf_dir):
    """Two sweeps of a rank-one fit of what customers spend at suppliers."""
    return _long(block_fit(_cells(spark, sf_dir, F.log("price")), ["intercept", "x"], 1, ridge=1.0, sweeps=2, tol=0.0), spark)


@query(reweighted_sql("poisson", "items", 2, 1))
def distributed_poisson_fit(spark, sf_dir):
    """Two reweighted steps for the number of items."""
    return _long(block_fit(_cells(spark, sf_dir, F.col("items")), ["intercept", "x"], family="poisson", sweeps=1, tol=0.0, outer=2), spark)


@query(reweighted_sql("binary", "CASE WHEN price > 40000 THEN 1.0 ELSE 0.0 END", 2, 1))
def distributed_binary_fit(spark, sf_dir):
    """Two reweighted steps for whether a customer spends more than 40,000 at a supplier."""
    return _long(block_fit(_cells(spark, sf_dir, F.when(F.col("price") > 40000, 1.0).otherwise(0.0)), ["intercept", "x"], family="binary", sweeps=1, tol=0.0, outer=2), spark)


def bootstrap_sql(weight: str, replicates: int) -> str:
    """Intervals of an intercept and a slope from blocks of customers, whose weights are keyed by MD5."""
    u = f"(CAST(CAST('0x' || substr(md5('17:' || i || ':' || k), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296"
    return with_(
        d.SPENDING_SQL,
        "b AS MATERIALIZED (SELECT i, count(*) AS n, sum(discount) AS x, sum(discount * discount) AS xx, sum(ln(price)) AS y, sum(discount * ln(price)) AS xy FROM spending GROUP BY i)",
        f"w AS (SELECT k, {weight.format(u=u)} AS w, b.* FROM b CROSS JOIN range(1, {replicates + 1}) g(k))",
        "s AS (SELECT k, sum(w * n) AS n, sum(w * x) AS x, sum(w * xx) AS xx, sum(w * y) AS y, sum(w * xy) AS xy FROM w GROUP BY k)",
        "v AS (SELECT 'intercept' AS term, (xx * y - x * xy) / (n * xx - x * x) AS v FROM s UNION ALL SELECT 'x', (n * xy - x * y) / (n * xx - x * x) FROM s)",
        select=f"SELECT term, {_round('avg(v)', 'mean')}, {_round('stddev_samp(v)', 'std_error')}, {_round('quantile_cont(v, 0.025)', 'low')}, {_round('quantile_cont(v, 0.975)', 'high')} FROM v GROUP BY term",
    )


@query(bootstrap_sql("-ln({u})", 200))
def bootstrap_one_pass(spark, sf_dir):
    """Intervals of 200 replicates over customers from one aggregation of the cells."""
    draws = bootstrap_draws(_cells(spark, sf_dir, F.log("price")), ["intercept", "x"], 200, ("i",))
    return rounded(bootstrap_intervals(draws), FIT_DIGITS)


def _count_sql() -> str:
    """How many steps of the Poisson distribution function a uniform number is above."""
    steps = [sum(math.exp(-1) / math.factorial(m) for m in range(k + 1)) for k in range(12)]
    return " + ".join(f"CASE WHEN {{u}} > {s!r} THEN 1 ELSE 0 END" for s in steps)


@query(bootstrap_sql(_count_sql(), 200))
def bootstrap_counts(spark, sf_dir):
    """The same with counts of mean 1 as weights."""
    draws = bootstrap_draws(_cells(spark, sf_dir, F.log("price")), ["intercept", "x"], 200, ("i",), scheme="poisson")
    return rounded(bootstrap_intervals(draws), FIT_DIGITS)


ALIGN_SQL = """pos AS (SELECT t, i AS actor, sum(y) AS u0, sum(x) / 50 AS u1 FROM activity GROUP BY t, i),
pe AS (SELECT t, lag(t) OVER (ORDER BY t) AS bf, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM pos)),
mm AS (SELECT p.k, sum(a.u0 * b.u0) AS m00, sum(a.u0 * b.u1) AS m01, sum(a.u1 * b.u0) AS m10, sum(a.u1 * b.u1) AS m11 FROM pe p JOIN pos a ON a.t = p.t JOIN pos b ON b.t = p.bf AND b.actor = a.actor GROUP BY p.k),
tu(k, q00, q01, q10, q11) AS (
  SELECT CAST(1 AS BIGINT), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT k, CASE WHEN d >= 0 THEN a / h ELSE e / g END, CASE WHEN d >= 0 THEN -b / h ELSE f / g END, CASE WHEN d >= 0 THEN b / h ELSE f / g END, CASE WHEN d >= 0 THEN a / h ELSE -e / g END
  FROM (SELECT k, n00 * n11 - n01 * n10 AS d, n00 + n11 AS a, n10 - n01 AS b, sqrt((n00 + n11) * (n00 + n11) + (n10 - n01) * (n10 - n01)) AS h, n00 - n11 AS e, n01 + n10 AS f, sqrt((n00 - n11) * (n00 - n11) + (n01 + n10) * (n01 + n10)) AS g
    FROM (SELECT mm.k, m00 * q00 + m01 * q10 AS n00, m00 * q01 + m01 * q11 AS n01, m10 * q00 + m11 * q10 AS n10, m10 * q01 + m11 * q11 AS n11 FROM tu JOIN mm ON mm.k = tu.k + 1))
)"""


@query("WITH RECURSIVE " + d.ACTIVITY_SQL + ", " + ALIGN_SQL + f"\nSELECT pos.t, actor, {_round('u0 * q00 + u1 * q10', 'u0')}, {_round('u0 * q01 + u1 * q11', 'u1')} FROM pos JOIN pe ON pe.t = pos.t JOIN tu ON tu.k = pe.k")
def aligned_positions(spark, sf_dir):
    """Weekly positions of users, each week turned onto the one before."""
    a = d.activity(spark, sf_dir).groupBy("t", F.col("i").alias("actor")).agg(F.array(F.sum("y"), F.sum("x") / 50).alias("u"))
    return rounded(dyads.aligned_over_time(a, 2).select("t", "actor", F.get("u", F.lit(0)).alias("u0"), F.get("u", F.lit(1)).alias("u1")), FIT_DIGITS)


@query(with_(d.ACTIVITY_SQL, select=f"SELECT CAST(CAST(i AS INTEGER) % 2 AS INTEGER) AS chain, CAST(i AS INTEGER) AS draw, 'x' AS block, j AS term, t, {_round('x', 'value')} FROM activity WHERE CAST(i AS INTEGER) % 2 = 1"))
def packed_draws(spark, sf_dir):
    """Weekly sums as draws of two blocks and chains: packed, and one block and chain of them read back."""
    a = d.activity(spark, sf_dir).withColumn("draw", F.col("i").cast("int"))
    long = a.select(F.pmod("draw", F.lit(2)).cast("int").alias("chain"), "draw", F.inline(F.array(F.struct(F.lit("x").alias("block"), F.col("x").alias("value")), F.struct(F.lit("y").alias("block"), F.col("y").alias("value")))), F.col("j").alias("term"), "t")
    path = scratch_path(spark, "packed")
    pack(long.withColumns({"i": F.lit(None).cast("string"), "j": F.lit(None).cast("string")}), path)
    return rounded(unpack(spark, path, "x", 1).select("chain", "draw", "block", "term", "t", "value"), FIT_DIGITS)


def _log_cdf_sql(z: str) -> str:
    """log Phi as the columns compute it."""
    k = f"(1 / (1 + 0.2316419 * abs({z})))"
    p = f"least(1.0, 2 * 0.3989422804014327 * exp(-({z}) * ({z}) / 2) * (((((1.330274429 * {k} - 1.821255978) * {k} + 1.781477937) * {k} - 0.356563782) * {k} + 0.319381530) * {k}))"
    q = f"(1 / (({z}) * ({z})))"
    tail = f"-0.5 * ({z}) * ({z}) - ln(-({z})) - 0.9189385332046727 + ln(1 - {q} * (1 - 3 * {q} * (1 - 5 * {q} * (1 - 7 * {q}))))"
    return f"CASE WHEN {z} < -5 THEN {tail} WHEN {z} < 0 THEN ln({p} / 2) ELSE ln(1 - {p} / 2) END"


def rank_sql(nodes: int, depth: int) -> str:
    """A recursion over the places of the ranking, for each user, week and node."""
    bases = [b for b in range(2, 100) if all(b % k for k in range(2, b))][:depth]
    points = " UNION ALL ".join(f"SELECT k, {n + 1} AS r, list_sum(list_transform(range(0, 40), lambda p: CAST(CAST(floor((k + 31) / pow({b}, p)) AS BIGINT) % {b} AS DOUBLE) / pow({b}, p + 1))) AS u FROM range(0, {nodes}) g(k)" for n, b in enumerate(bases))
    return (
        f"WITH RECURSIVE {d.ACTIVITY_SQL}, it AS (SELECT t, i, j, (x - 50) / 50 AS eta, y FROM activity), "
        "rk AS MATERIALIZED (SELECT t, i, eta, row_number() OVER (PARTITION BY t, i ORDER BY y DESC, j) AS r FROM it WHERE y >= 2), fr AS (SELECT t, i, eta FROM it WHERE y < 2), "
        f"nd AS MATERIALIZED ({points}), "
        f"f(t, i, k, r, weight, above) AS (SELECT t, i, k, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT t, i FROM rk) CROSS JOIN range(0, {nodes}) g(k) "
        f"UNION ALL SELECT t, i, k, r, weight + lp, least(eta + {_quantile_sql('p')}, coalesce(above, eta + {_quantile_sql('p')})) FROM (SELECT *, least(greatest(u * exp(lp), 1e-300), 1 - 1e-16) AS p "
        f"FROM (SELECT f.t, f.i, f.k, rk.r, weight, above, eta, u, CASE WHEN above IS NULL THEN 0 ELSE {_log_cdf_sql('(above - eta)')} END AS lp FROM f JOIN rk ON rk.t = f.t AND rk.i = f.i AND rk.r = f.r + 1 JOIN nd ON nd.k = f.k AND nd.r = rk.r))), "
        "la AS (SELECT t, i, max(r) AS r FROM rk GROUP BY t, i), "
        f"en AS (SELECT f.t, f.i, f.k, min(weight) + coalesce(sum(CASE WHEN fr.eta IS NOT NULL THEN {_log_cdf_sql('(above - fr.eta)')} END), 0) AS w FROM f JOIN la ON la.t = f.t AND la.i = f.i AND la.r = f.r LEFT JOIN fr ON fr.t = f.t AND fr.i = f.i GROUP BY f.t, f.i, f.k), "
        f"tp AS (SELECT t, i, max(w) AS m FROM en GROUP BY t, i)\nSELECT en.t, en.i, {_round('min(m) + ln(avg(exp(w - m)))', 'log_probability')} FROM en JOIN tp ON tp.t = en.t AND tp.i = en.i GROUP BY en.t, en.i"
    )


@query(rank_sql(32, 5))
def rank_likelihood(spark, sf_dir):
    """How likely a user's weekly order of event types is, given scores from the values; types met once only are not ranked."""
    a = d.activity(spark, sf_dir).withColumn("eta", (F.col("x") - 50) / 50)
    of = lambda c: F.sort_array(F.collect_list(F.when(c, F.struct((-F.col("y")).alias("y"), "j", "eta"))))
    sides = a.groupBy("t", "i").agg(of(F.col("y") >= 2).alias("e"), of(F.col("y") < 2).alias("f")).where(F.size("e") > 0)
    ranked = sides.select("t", "i", *[F.transform(c, lambda x: x["eta"]).alias(c) for c in ("e", "f")])
    return rounded(rankings.rank_log_probability(ranked, ["t", "i"], 32), FIT_DIGITS)
