"""Fits as objects over tables: chains, point estimates, replicates, and what is derived from them.

A fit's draws are a long table, written once to the shared folder; summaries are
queries over it (relata.operators.summaries).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.functions.distributions import inverse_link, normal_cdf
from relata.operators import design as d
from relata.operators import evaluation, statistics, summaries
from relata.operators.dyads import aligned_over_time, centred_products
from relata.plans.als import Als, AlsOptions, best_of_starts, bootstrap_replicate
from relata.plans.arrays import DRAWS, Panel, fan_out
from relata.plans.gibbs import Chain, Options, observed, path_step, pointwise
from relata.sources.draws import pack, unpack
from relata.session import written
from relata.sources.edges import long_covariates

SEED_STEP = 101


class NotAvailable(TypeError):
    """The fit has nothing that this could be computed from."""


@dataclass
class Data:
    """A design table with the names of its design columns."""

    dyads: DataFrame
    names: list[str]
    square: bool = True

    @classmethod
    def of(cls, dyads: DataFrame, dyadic: Sequence[str] = (), nodes: DataFrame | None = None, row: Sequence[str] = (), col: Sequence[str] = (), square: bool = True, intercept: bool = True) -> Data:
        frame, names = d.design(dyads, dyadic, nodes, row, col, intercept)
        return cls(frame.select("t", "i", "j", "y", *names), names, square)


def chains(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(k,) for k in range(n)], "task int")


def sampled_fit(data: Data, options: Options | None = None, n_chains: int = 1, start: AlsOptions | bool = False, **settings) -> BayesFit:
    """Sampled fit of one or more periods with static or moving parts, one task per chain.

    start: chains begin at a point estimate, which each task makes for itself, with a little noise.
    """
    options = options or Options(**settings)
    if start is True:
        start = AlsOptions(family=options.family if options.family in ("normal", "binary", "poisson") else "normal", symmetric=options.symmetric, rank=options.rank, rank_col=options.rank_col, seed=options.seed)
    if options.family == "ordinal":
        data = Data(data.dyads, [n for n in data.names if n != "intercept"], data.square)

    def fit(panel: Panel, task: dict) -> pd.DataFrame:
        chain = int(task["task"])
        begin = start_values(panel, start, options.seed + chain) if start else None
        return Chain(panel, replace(options, seed=options.seed + SEED_STEP * chain), chain, begin).run().frame()

    draws = fan_out(data.dyads, chains(data.dyads.sparkSession, n_chains), data.names, fit, DRAWS, data.square)
    return BayesFit(data, options, written(draws, "draws"), n_chains)


def start_values(panel: Panel, options: AlsOptions, seed: int, jitter: float = 0.01) -> dict:
    """A chain's state at a point estimate: coefficients, effects, factors and scales."""
    fit, rng = best_of_starts(panel, options), np.random.default_rng([seed, 3])
    noise = lambda x: x + jitter * rng.standard_normal(x.shape)
    vc = fit.components()
    beta = np.zeros((len(panel.names), panel.shape[2]))
    for k, name in enumerate(panel.names):
        beta[k] = fit.mu_path if name == "intercept" else fit.beta[fit.names.index(name)]
    out = {"beta": beta, "a": noise(fit.a), "b": noise(fit.b), "sab": np.array([[max(vc["va"], 1e-3), vc["cab"]], [vc["cab"], max(vc["vb"], 1e-3)]])}
    if fit.r:
        out |= {"u": noise(fit.u), "v": noise(fit.v), "g": fit.g.copy()}
    if options.family == "normal":
        out["s2"] = max(vc["ve"], 1e-3)
    return out


@dataclass
class BayesFit:
    data: Data
    options: Options
    draws: DataFrame
    n_chains: int = 1

    @property
    def beta(self) -> DataFrame:
        return self.draws.where("block = 'beta'")

    @property
    def by(self) -> list[str]:
        return ["term", "t"] if self.options.dynamic_beta else ["term"]

    def block(self, name: str) -> DataFrame:
        return self.draws.where(F.col("block") == name)

    def coef(self) -> DataFrame:
        return summaries.coefficients(self.beta, self.by)

    def vcov(self) -> DataFrame:
        return summaries.covariances(self.beta, self.by)

    def confint(self, level: float = 0.95) -> DataFrame:
        return summaries.intervals(self.beta, level, self.by)

    def tidy(self, level: float = 0.95) -> DataFrame:
        return summaries.tidy(self.beta, level, self.by)

    def summary(self) -> DataFrame:
        """Coefficients and variance components, with R-hat and effective draws."""
        both = self.draws.where("block in ('beta', 'vc')")
        key = ["block", "term", "t"]
        keyed = both.withColumn("t", F.coalesce("t", F.lit(-1)))
        out = summaries.tidy(keyed, by=key).join(summaries.rhat(keyed, key).drop("chains"), key, "left").join(summaries.effective_size(keyed, key), key, "left")
        return out.withColumn("t", F.when(F.col("t") >= 0, F.col("t")))

    def glance(self) -> DataFrame:
        n = self.data.dyads.agg(F.count("y").alias("nobs"), F.countDistinct("i").alias("n_row"), F.countDistinct("j").alias("n_col"), F.countDistinct("t").alias("n_periods"))
        kept = self.beta.select("chain", "draw").distinct().agg(F.count("*").alias("n_draws"))
        o = self.options
        return n.crossJoin(kept).select("*", F.lit(o.family).alias("family"), F.lit("unipartite" if self.data.square else "bipartite").alias("mode"), F.lit(o.rank).alias("rank"), F.lit(o.symmetric).alias("symmetric"), F.lit(bool(o.dynamic_ab)).alias("dynamic_ab"), F.lit(bool(o.dynamic_beta)).alias("dynamic_beta"), F.lit(str(o.dynamic_uv or "no")).alias("dynamic_uv"))

    def nobs(self) -> int:
        return self.data.dyads.agg(F.count("y")).first()[0]

    def as_draws(self, blocks: Sequence[str] = ("beta", "vc")) -> DataFrame:
        return self.draws.where(F.col("block").isin(*blocks)).select("chain", "draw", "block", "term", "t", "value")

    def surface(self, block: str) -> DataFrame:
        """(t, i, j, value): a stored mean over draws, averaged over chains."""
        return self.block(block).groupBy("t", "i", "j").agg(F.avg("value").alias("value"))

    def eta(self) -> DataFrame:
        return self.surface("eta_mean")

    def fitted(self) -> DataFrame:
        return self.surface("fitted_mean")

    def residuals(self, kind: str = "response") -> DataFrame:
        out = self.data.dyads.select("t", "i", "j", "y").join(self.fitted(), ["t", "i", "j"])
        e = F.col("y") - F.col("value")
        if kind == "response":
            return out.select("t", "i", "j", e.alias("residual"))
        ve = self.block("vc").where("term = 've'").agg(F.avg("value")).first()[0]
        f = self.options.family
        spread = F.sqrt(F.col("value") * (1 - F.col("value")) + 1e-12) if f in ("binary", "cbin") else F.sqrt(F.greatest("value", F.lit(1e-12))) if f == "poisson" else F.lit(float(ve) ** 0.5)
        return out.select("t", "i", "j", (e / spread).alias("residual"))

    def effects(self, side: str = "row", level: float = 0.95) -> DataFrame:
        """Additive effects with intervals: the data of an effect chart."""
        key = ["actor", "t"]
        rows = self.block("a" if side == "row" else "b").withColumnRenamed("i", "actor").withColumn("t", F.coalesce("t", F.lit(-1)))
        out = summaries.tidy(rows, level, key).select(*key, "estimate", "std_error", "conf_low", "conf_high")
        return out.withColumn("t", F.when(F.col("t") >= 0, F.col("t")))

    def latent_positions(self) -> DataFrame:
        """(actor, side, dimension, t, value, posterior_sd); positions are only known up to a rotation, their products are not."""
        rows = self.draws.where("block in ('u', 'v')")
        side = F.when(F.col("block") == "u", "row").otherwise("col")
        return rows.groupBy(F.col("i").alias("actor"), side.alias("side"), F.col("term").cast("int").alias("dimension"), "t").agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("posterior_sd"))

    def multiplicative_draws(self) -> DataFrame:
        """(chain, draw, t, i, j, value): u' G v of each stored draw."""
        return products(self.draws, self.data.square)

    def multiplicative(self) -> DataFrame:
        return self.multiplicative_draws().groupBy("t", "i", "j").agg(F.avg("value").alias("value"))

    def quantiles(self, component: str = "beta", probs: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
        if component == "beta":
            return summaries.quantiles(self.beta, probs, self.by)
        if component == "ab":
            return summaries.quantiles(self.draws.where("block in ('a', 'b')"), probs, ("block", "i", "t"))
        if component == "UV":
            return summaries.quantiles(self.multiplicative_draws(), probs, ("t", "i", "j"))
        raise ValueError("the component is beta, ab or UV")

    def predict(self, newdata: DataFrame | None = None, kind: str = "response") -> DataFrame:
        """(t, i, j, value) for the data, or for other covariates (t, i, j, named columns) with the stored effects."""
        if newdata is None:
            return self.fitted() if kind == "response" else self.eta()
        mean = self.eta_draws(newdata).groupBy("t", "i", "j").agg(F.avg(self._mean("value") if kind == "response" else F.col("value")).alias("value"))
        return mean

    def _mean(self, column: str):
        f = self.options.family
        return F.exp(F.least(F.col(column) + F.col("ve") / 2, F.lit(15.0))) if f == "poisson" else inverse_link(f, F.col(column))

    def eta_draws(self, design: DataFrame | None = None) -> DataFrame:
        """(chain, draw, t, i, j, value, ve): the linear predictor of each stored draw at each cell. Draws meet cells by joins on names."""
        design = self.data.dyads if design is None else design
        unit = ["chain", "draw"]
        beta = self.beta.select(*unit, "term", F.col("t").alias("at"), "value")
        long = long_covariates(design.select("t", "i", "j", *self.data.names), self.data.names).withColumnRenamed("name", "term").withColumnRenamed("value", "x") if self.data.names else None
        draws = self.block("vc").where("term = 've'").select(*unit, F.col("value").alias("ve"))
        if long is not None:
            match = (F.col("l.term") == F.col("b.term")) & (F.col("b.at").isNull() | (F.col("b.at") == F.col("l.t")))
            out = long.alias("l").join(F.broadcast(beta).alias("b"), match).groupBy(*unit, "t", "i", "j").agg(F.sum(F.col("l.x") * F.col("b.value")).alias("value"))
        else:
            out = design.select("t", "i", "j").crossJoin(draws.select(*unit)).withColumn("value", F.lit(0.0))
        for block, at in (("a", "i"), ("b", "j")):
            e = self.block(block).select(*unit, F.col("i").alias(at), F.col("t").alias("at"), F.col("value").alias("e"))
            dynamic = self.options.dynamic_ab
            key = [*unit, at, *(["t"] if dynamic else [])]
            out = out.join(e.withColumnRenamed("at", "t") if dynamic else e.drop("at"), key, "left").withColumn("value", F.col("value") + F.coalesce("e", F.lit(0.0))).drop("e")
        if self.options.actor_slope:
            at = "i" if self.options.actor_side == "row" else "j"
            own = self.block("slope").select(*unit, "t", F.col("i").alias(at), F.col("value").alias("own"))
            x = design.select("t", "i", "j", F.col(self.options.actor_slope).alias("x"))
            out = out.join(x, ["t", "i", "j"]).join(own, [*unit, "t", at], "left").withColumn("value", F.col("value") + F.coalesce("own", F.lit(0.0)) * F.col("x")).drop("own", "x")
        if self.options.rank:
            uv = products(self.draws, self.data.square).withColumnRenamed("value", "e")
            static = not (self.options.dynamic_uv or self.options.dynamic_g)
            key = [*unit, *([] if static else ["t"]), "i", "j"]
            out = out.join(uv.drop("t") if static else uv, key, "left").withColumn("value", F.col("value") + F.coalesce("e", F.lit(0.0))).drop("e")
        return out.join(draws, unit).select(*unit, "t", "i", "j", "value", "ve")

    def simulate(self, n: int | None = None, seed: int = 29, newdata: DataFrame | None = None, thin: int = 1, burn: int = 0) -> DataFrame:
        """(chain, draw, t, i, j, value): a response for each stored draw, errors keyed by draw and unordered pair, so partitioning is of no effect."""
        eta = self.eta_draws(newdata).where((F.col("draw") > burn) & (F.col("draw") % thin == 0))
        if n is not None:
            eta = summaries.saved_draws(eta, n, seed)
        rho = self.block("vc").where("term = 'rho'").groupBy("chain", "draw").agg(F.avg("value").alias("rho"))
        z = with_noise(eta.join(rho, ["chain", "draw"]), self.data.square, self.options.symmetric, seed)
        return shown(z, self.options, self.data, seed)

    def loglik(self) -> DataFrame:
        """Pointwise log-likelihoods (chain, draw, t, i, j, ll), kept by the chains or made from the draws per draw."""
        kept = self.block("loglik")
        if self.options.keep_loglik:
            return kept.select("chain", "draw", "t", "i", "j", F.col("value").alias("ll"))
        both = self.eta_draws().join(self.data.dyads.select("t", "i", "j", "y"), ["t", "i", "j"]).where("y is not null")
        family = self.options.family

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            p = Panel.from_frame(pdf.assign(y=pdf["y"]), [], False)
            e = Panel.from_frame(pdf.assign(y=pdf["value"]), [], False)
            ll = pointwise(p.y, np.nan_to_num(e.y), family, float(pdf["ve"].iloc[0]))
            i, j, t = np.nonzero(p.seen)
            return pd.DataFrame({"chain": pdf["chain"].iloc[0], "draw": pdf["draw"].iloc[0], "t": np.array(p.periods)[t], "i": np.array(p.rows)[i], "j": np.array(p.columns)[j], "ll": ll[i, j, t]})

        return both.groupBy("chain", "draw").applyInPandas(one, "chain int, draw int, t int, i string, j string, ll double")

    def waic(self) -> DataFrame:
        return summaries.waic(self.loglik())

    def loo(self) -> DataFrame:
        point = summaries.psis_loo(self.loglik())
        return point.agg(F.sum("elpd").alias("elpd_loo"), (-2 * F.sum("elpd")).alias("looic"), (2 * F.sqrt(F.count("*") * F.var_samp("elpd"))).alias("se"), F.sum((F.col("k") > 0.7).cast("int")).alias("n_bad"))

    def log_lik(self):
        raise NotAvailable("a sampled fit has no point log-likelihood; use loglik() for draws")

    def formula(self):
        raise NotAvailable("models are given by tables, not by a formula")

    def gof(self) -> DataFrame:
        """(term, observed, mean, conf_low, conf_high, p): statistics against those of simulated networks, averaged over periods on both sides."""
        seen = self.block("gof_observed").groupBy("term").agg(F.avg("value").alias("observed"))
        made = self.block("gof").groupBy("chain", "draw", "term").agg(F.avg("value").alias("value"))
        q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
        both = made.join(seen, "term").groupBy("term", "observed").agg(F.avg("value").alias("mean"), q.alias("q"), F.avg((F.col("value") >= F.col("observed")).cast("double")).alias("p"))
        return both.select("term", "observed", "mean", F.col("q")[0].alias("conf_low"), F.col("q")[1].alias("conf_high"), "p")

    def gof_periods(self) -> DataFrame:
        seen = self.block("gof_observed").groupBy("term", "t").agg(F.avg("value").alias("observed"))
        return summaries.intervals(self.block("gof"), 0.95, ("term", "t")).join(seen, ["term", "t"])

    def gof_custom(self, custom: dict[str, Callable], n: int = 50, seed: int = 29) -> DataFrame:
        """User statistics of the data and of n simulated panels, averaged over periods."""
        made = self.simulate(n, seed).withColumnRenamed("value", "y")
        one = statistics.custom_statistics(made, custom, ("chain", "draw", "t"))
        seen = statistics.custom_statistics(self.data.dyads, custom, ("t",))
        names = list(custom)
        out = one.groupBy("chain", "draw").agg(*[F.avg(n).alias(n) for n in names]).unpivot(["chain", "draw"], names, "term", "value")
        return out.join(seen.agg(*[F.avg(n).alias(n) for n in names]).unpivot([], names, "term", "observed"), "term")

    def gof_temporal(self, name: str = "density", n: int = 100, seed: int = 29) -> DataFrame:
        made = self.simulate(n, seed).select(F.concat_ws("-", "chain", "draw").alias("rep"), "t", "i", "j", F.col("value").alias("y"))
        return statistics.temporal_trend(self.data.dyads, made, name)

    def snap_indicators(self, side: str = "u") -> DataFrame:
        rows = self.block(f"snap_{side}")
        return rows.select(F.concat_ws("-", "chain", "draw").alias("draw"), F.col("i").alias("actor"), F.col("t").alias("year"), "value")

    def change_points(self, n_prior: int = 500, seed: int = 29, threshold: float = 10.0) -> DataFrame:
        if not self.options.dynamic_beta:
            raise NotAvailable("no coefficient moves")
        periods = [r.t for r in self.data.dyads.select("t").distinct().orderBy("t").collect()]
        terms = self.beta.where("t is not null").select("term").distinct()
        prior = prior_paths(terms, periods, n_prior, "ar1", seed)
        return summaries.change_points(self.beta.where("t is not null"), prior, ("term",), threshold)

    def rhat_paths(self) -> DataFrame:
        return summaries.multivariate_rhat(self.beta.where("t is not null"))

    def forecast(self, h: int = 1, newdata: DataFrame | None = None, seed: int = 29, by_draw: bool = False, kind: str = "response") -> DataFrame:
        """(h, i, j, value): moving parts of each draw carried h periods on by their autoregression, static ones as they are.

        Covariates are those of newdata (t is the step, 1 to h) or the last period's. Errors are keyed by hashes.
        """
        last = self.data.dyads.agg(F.max("t")).first()[0]
        steps = self.data.dyads.sparkSession.range(1, h + 1).select(F.col("id").cast("int").alias("h"))
        cells = newdata.withColumnRenamed("t", "h") if newdata is not None else self.data.dyads.where(F.col("t") == last).drop("t", "y").crossJoin(steps)
        moved = advance(self, last, h, seed)
        ahead = BayesFit(Data(cells.withColumn("t", F.col("h")).withColumn("y", F.lit(None).cast("double")), self.data.names, self.data.square), self.options, moved)
        eta = ahead.eta_draws(cells.withColumnRenamed("h", "t"))
        value = self._mean("value") if kind == "response" else F.col("value")
        out = eta.select("chain", "draw", F.col("t").alias("h"), "i", "j", value.alias("value"))
        return out if by_draw else out.groupBy("h", "i", "j").agg(F.avg("value").alias("value"))

    def state_table(self) -> DataFrame:
        """What a later run starts from: the last stored values of every block."""
        last = self.draws.where("block not in ('gof', 'gof_observed')").groupBy("chain").agg(F.max("draw").alias("draw"))
        kept = self.draws.where("draw = 0 and block not in ('gof_observed')").unionByName(self.draws.join(last, ["chain", "draw"], "left_semi"))
        return kept.where("block <> 'gof'")

    def save(self, path: str, packed: bool = False) -> None:
        """Draws as Parquet by block, one number a row or packed to arrays, and the options as JSON, readable by `load`."""
        import json

        if packed:
            pack(self.draws, f"{path}/packed")
        else:
            self.draws.write.partitionBy("block").parquet(f"{path}/draws")
        meta = asdict(self.options) | {"names": self.data.names, "square": self.data.square, "n_chains": self.n_chains, "packed": packed}
        self.draws.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(f"{path}/meta")
        self.data.dyads.write.parquet(f"{path}/dyads")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BayesFit:
        import json

        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        names, square, n, is_packed = meta.pop("names"), meta.pop("square"), meta.pop("n_chains"), meta.pop("packed", False)
        tuples = ("time_index", "exposure", "dynamic_beta")
        options = Options(**{k: tuple(v) if k in tuples and isinstance(v, list) else v for k, v in meta.items()})
        draws = unpack(spark, f"{path}/packed") if is_packed else spark.read.parquet(f"{path}/draws")
        return cls(Data(spark.read.parquet(f"{path}/dyads"), names, square), options, draws.select(*[c.split()[0] for c in DRAWS.split(", ")]), n)

    def resume(self, scan: int) -> BayesFit:
        """More draws after the last ones, from each chain's stored state; needs the effects to be kept."""
        if not (self.options.keep_ab and (self.options.keep_uv or not self.options.rank)):
            raise NotAvailable("the chains' effects were not kept")
        options = replace(self.options, scan=scan, burn=0)
        states = state_by_chain(self)
        names, square = self.data.names, self.data.square

        def fit(panel: Panel, task: dict) -> pd.DataFrame:
            chain = int(task["task"])
            start = restore(panel, options, states[chain])
            return Chain(panel, replace(options, seed=options.seed + SEED_STEP * chain + 1), chain, start).run().frame()

        more = fan_out(self.data.dyads, chains(self.data.dyads.sparkSession, self.n_chains), names, fit, DRAWS, square)
        done = self.beta.agg(F.max("draw")).first()[0] or 0
        more = more.withColumn("draw", F.when(F.col("draw") > 0, F.col("draw") + done).otherwise(F.col("draw")))
        old = self.draws.where("draw > 0")
        return BayesFit(self.data, self.options, written(old.unionByName(more), "draws"), self.n_chains)

    def update(self, **changes) -> BayesFit:
        """The same data under changed options."""
        return sampled_fit(self.data, replace(self.options, **changes), self.n_chains)

    def centred_multiplicative(self) -> DataFrame:
        """The mean multiplicative surface without its margins, and the margins, which belong to the additive terms."""
        return centred_products(self.multiplicative(), ["t"] if self.options.dynamic_uv or self.options.dynamic_g else [])

    def aligned_positions(self, side: str = "u") -> DataFrame:
        """(t, actor, u): mean positions with each period rotated onto the one before."""
        rows = self.block(side).where("t is not null").groupBy("t", F.col("i").alias("actor"), F.col("term").cast("int").alias("r")).agg(F.avg("value").alias("value"))
        wide = rows.groupBy("t", "actor").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("u"))
        return aligned_over_time(wide, self.options.rank)

    def trace(self, blocks: Sequence[str] = ("beta", "vc")) -> DataFrame:
        """(block, term, t, chain, iteration, value): the data of a trace chart."""
        from pyspark.sql import Window

        w = Window.partitionBy("block", "term", "t", "chain").orderBy("draw")
        return self.draws.where(F.col("block").isin(*blocks)).select("block", "term", "t", "chain", F.row_number().over(w).alias("iteration"), "value")

    def top_positions(self, n: int = 10) -> DataFrame:
        """(actor, side, t, size): the actors farthest from the origin, for labels of a position chart."""
        sized = self.latent_positions().groupBy("actor", "side", "t").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
        return sized.orderBy(F.desc("size"), "side", "actor", "t").limit(n)

    def most_variable_effects(self, n: int = 20) -> DataFrame:
        """(block, actor, variance): the actors whose moving effects vary most over periods."""
        mean = self.draws.where("block in ('a', 'b') and t is not null").groupBy("block", F.col("i").alias("actor"), "t").agg(F.avg("value").alias("m"))
        return mean.groupBy("block", "actor").agg(F.var_samp("m").alias("variance")).orderBy(F.desc("variance"), "block", "actor").limit(n)

    def memory(self) -> DataFrame:
        """Stored values and bytes by block, largest first."""
        return self.draws.groupBy("block").agg(F.count("*").alias("values"), (8 * F.count("*")).alias("bytes")).orderBy(F.desc("bytes"))

    def describe(self) -> str:
        o = self.options
        mode = "symmetric" if o.symmetric else "unipartite" if self.data.square else "bipartite"
        moving = [n for n, on in (("additive effects", o.dynamic_ab), ("coefficients", o.dynamic_beta), ("factors", o.dynamic_uv), ("mixing", o.dynamic_g), ("reciprocity", o.dynamic_rho)) if on]
        return f"Gibbs sampler, {o.family} {mode} model of rank {o.rank}, {self.n_chains} chain(s) of {o.burn} + {o.scan} sweeps, every {o.thin}th kept; moving: {', '.join(moving) or 'nothing'}"

    def priors(self) -> dict:
        return {"g": self.options.prior.get("g", "number of observed cells"), "sab": self.options.prior.get("sab", 0.25), "s2": "inverse gamma (1/2, 1/2)", "rho": "uniform on (-0.995, 0.995)", "kappa": self.options.prior.get("kappa", 1.0), "nu": self.options.prior.get("nu", 4.0)}


def products(draws: DataFrame, square: bool) -> DataFrame:
    """u' G v per draw, by joins on the dimension."""
    unit = ["chain", "draw"]
    u = draws.where("block = 'u'").select(*unit, F.col("t").alias("tu"), "i", F.col("term").alias("r"), F.col("value").alias("u"))
    v = draws.where("block = 'v'").select(*unit, F.col("t").alias("tv"), F.col("i").alias("j"), F.col("term").alias("s"), F.col("value").alias("v"))
    if not square:
        g = draws.where("block = 'g'").select(*unit, F.col("t").alias("tg"), F.split("term", ",")[0].alias("r"), F.split("term", ",")[1].alias("s"), F.col("value").alias("g"))
        u = u.join(g, [*unit, "r"]).where("tu is null or tg is null or tu = tg").groupBy(*unit, F.coalesce("tu", "tg").alias("tu"), "i", "s").agg(F.sum(F.col("u") * F.col("g")).alias("u"))
        u = u.withColumnRenamed("s", "r")
    both = u.join(v.withColumnRenamed("s", "r"), [*unit, "r"]).where("tu is null or tv is null or tu = tv")
    out = both.groupBy(*unit, F.coalesce("tu", "tv").alias("t"), "i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("value"))
    return out.where("i <> j") if square else out


def hash_normal(*keys) -> F.Column:
    """A standard normal from two hashes of the keys (Box and Muller)."""
    unit = lambda salt: (F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))


def with_noise(eta: DataFrame, square: bool, symmetric: bool, seed: int) -> DataFrame:
    """`z`: the predictor plus errors of variance ve; opposite cells have correlation rho, symmetric ones the same error."""
    unit = [F.col("chain"), F.col("draw"), F.col("t"), F.lit(seed)]
    if not square:
        return eta.withColumn("z", F.col("value") + F.sqrt("ve") * hash_normal(*unit, F.col("i"), F.col("j")))
    pair = [*unit, F.least("i", "j"), F.greatest("i", "j")]
    one, two = hash_normal(*pair, F.lit("a")), hash_normal(*pair, F.lit("b"))
    if symmetric:
        return eta.withColumn("z", F.col("value") + F.sqrt("ve") * one)
    p, q = F.sqrt(1 + F.col("rho")), F.sqrt(1 - F.col("rho"))
    plus, minus = (p + q) / 2, (p - q) / 2
    e = F.when(F.col("i") < F.col("j"), plus * one + minus * two).otherwise(plus * two + minus * one)
    return eta.withColumn("z", F.col("value") + F.sqrt("ve") * e)


def shown(z: DataFrame, options: Options, data: Data, seed: int) -> DataFrame:
    """The family's response of latent values z, for the observed cells."""
    cells = data.dyads.select("t", "i", "j", F.col("y").alias("seen"))
    rows = z.join(cells, ["t", "i", "j"]).where("seen is not null")
    unit = ["chain", "draw", "t", "i", "j"]
    f = options.family
    if f == "normal":
        return rows.select(*unit, F.col("z").alias("value"))
    if f == "binary":
        return rows.select(*unit, (F.col("z") > 0).cast("double").alias("value"))
    odmax, log_exposure = options.odmax, options.exposure

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Panel.from_frame(pdf.assign(y=pdf["seen"]), [], False)
        latent = Panel.from_frame(pdf.assign(y=pdf["z"]), [], False)
        most = odmax if odmax is not None else float(np.nanmax(np.nansum(p.y > 0, axis=1)))
        rng = np.random.default_rng([seed, int(pdf["chain"].iloc[0]), int(pdf["draw"].iloc[0])])
        y = observed(np.nan_to_num(latent.y, nan=-np.inf if f in ("cbin", "frn") else 0.0), f, p, most, rng, np.zeros(len(p.periods)) if log_exposure is None else np.log(np.array(log_exposure)))
        i, j, t = np.nonzero(p.seen)
        return pd.DataFrame({"chain": pdf["chain"].iloc[0], "draw": pdf["draw"].iloc[0], "t": np.array(p.periods)[t], "i": np.array(p.rows)[i], "j": np.array(p.columns)[j], "value": y[i, j, t]})

    return rows.groupBy("chain", "draw").applyInPandas(one, "chain int, draw int, t int, i string, j string, value double")


def advance(fit: BayesFit, last: int, h: int, seed: int) -> DataFrame:
    """The draws with t = 1..h instead of the panel's periods: x <- rho x + noise for what moves; positions begin anew or jump where the model has resets or heavy tails."""
    o, unit = fit.options, ["chain", "draw"]
    wide = fit.block("vc").groupBy(*unit).pivot("term").agg(F.first("value")) if o.dynamic_ab or o.dynamic_uv or o.dynamic_beta else None
    rows = fit.draws.where("block in ('beta', 'a', 'b', 'u', 'v', 'g', 'vc') and draw > 0")
    static = rows.where("t is null or block = 'vc'").withColumn("t", F.lit(None).cast("int"))
    if wide is None:
        return static
    at_last = rows.where((F.col("t") == last) & (F.col("block") != "vc"))
    if o.beta_kind == "rw2":  # walks of second order go on from their last two values
        times = sorted(r[0] for r in rows.where("block = 'beta' and t is not null").select("t").distinct().collect())
        order = len(times) >= 3
        before = rows.where((F.col("block") == "beta") & (F.col("t") == (times[-2] if order else last))).select(*unit, "block", "term", F.col("value").alias("before"))
        at_last = at_last.join(before, [*unit, "block", "term"], "left")
    else:
        order, at_last = False, at_last.withColumn("before", F.lit(0.0))
    # one side of a symmetric network is drawn, and the other mirrors it
    moving = (at_last.where("block not in ('b', 'v')") if o.symmetric else at_last).join(wide, unit)
    has = set(wide.columns)
    name = lambda stem, b: F.coalesce(*[F.when((F.col("block") == b) & (F.col("term") == n.split(":", 1)[1]), F.col(f"`{n}`")) for n in has if n.startswith(stem + ":")], F.lit(0.9 if stem == "rho_beta" else 0.1))
    pick = lambda n, default: F.col(n) if n in has else F.lit(default)
    path = o.beta_kind
    rho = F.when(F.col("block").isin("a", "b"), pick("rho_ab", 1.0)).when(F.col("block").isin("u", "v"), pick("rho_uv", 1.0)).when(F.col("block") == "beta", name("rho_beta", "beta") if path == "ar1" else F.lit(path_step(path, 1.0, 3 if order else 2)[0])).otherwise(1.0)
    second = F.when(F.col("block") == "beta", F.lit(path_step(path, 1.0, 3 if order else 2)[1])).otherwise(0.0)
    absent = [b for b, there in (("a", o.row_effects), ("b", o.col_effects)) if not there]
    var = F.when(F.col("block").isin(*absent), 0.0) if absent else F.when(F.lit(False), 0.0)
    var = var.when(F.col("block").isin("a", "b"), pick("sigma2_ab", 0.0)).when(F.col("block").isin("u", "v"), pick("sigma2_uv", 0.0)).when(F.col("block") == "beta", name("sigma2_beta", "beta")).otherwise(0.0)
    first = moving.withColumn("rho", rho).withColumn("second", second).withColumn("var", var).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    noise = lambda k: hash_normal("chain", "draw", "block", "term", F.coalesce("i", F.lit("")), k, F.lit(seed))
    kind = o.dynamic_uv if isinstance(o.dynamic_uv, str) else "ar1"
    kappa, nu = float(o.prior.get("kappa", 1.0)), int(o.prior.get("nu", 4))
    is_position = F.col("block").isin("u", "v")
    # what an actor's positions of one period share: whether they begin anew, and how heavy their innovation is
    shared = lambda k, *more: hash_normal("chain", "draw", "block", F.coalesce("i", F.lit("")), k, F.lit(seed + 1), *more)

    def step(state, k):
        move = F.sqrt("var") * noise(k)
        if kind == "t":
            chi = F.aggregate(F.array(*[shared(k, F.lit(m)) for m in range(nu)]), F.lit(0.0), lambda s, z: s + z * z)
            move = move * F.when(is_position, F.sqrt(nu / F.greatest(chi, F.lit(1e-12)))).otherwise(1.0)
        on = F.col("rho") * state["now"] + F.col("second") * state["before"] + move
        if kind == "snap":
            on = F.when(is_position & (normal_cdf(shared(k)) < pick("pi_snap", 0.1)), kappa * noise(k)).otherwise(on)
        return F.struct(on.alias("now"), state["now"].alias("before"))

    begin = F.struct(F.col("value").alias("now"), F.coalesce("before", F.lit(0.0)).alias("before"))
    total = F.aggregate(F.sequence(F.lit(1), F.col("h")), begin, step, lambda state: state["now"])
    ahead = first.withColumn("value", total).withColumn("t", F.col("h")).select(*static.columns)
    if o.symmetric:
        sign = at_last.where("block = 'u'").select(*unit, "term", "i", F.col("value").alias("u")).join(at_last.where("block = 'v'").select(*unit, "term", "i", F.col("value").alias("v")), [*unit, "term", "i"])
        sign = sign.select(*unit, "term", "i", F.signum(F.col("u") * F.col("v")).alias("sign"))
        other_b = ahead.where("block = 'a'").withColumn("block", F.lit("b")).withColumn("term", F.lit("b"))
        other_v = ahead.where("block = 'u'").join(sign, [*unit, "term", "i"]).withColumn("value", F.col("value") * F.col("sign")).withColumn("block", F.lit("v"))
        ahead = ahead.unionByName(other_b).unionByName(other_v.select(*static.columns))
    return static.unionByName(ahead)


def prior_paths(terms: DataFrame, periods: Sequence[int], n: int, kind: str, seed: int, rho_mean: float = 0.8, rho_sd: float = 0.15) -> DataFrame:
    """(term, chain, draw, t, value): coefficient paths from the prior, as long as the panel."""
    times = list(map(int, periods))
    spark = terms.sparkSession

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from relata.functions.distributions import truncated_normal
        from relata.functions.linear import precision_draw
        from relata.plans.gibbs import path_precision

        out = []
        for k in pdf["draw"]:
            rng = np.random.default_rng([seed, int(k)])
            rho = float(truncated_normal(rng, np.array([rho_mean]), rho_sd, 0.0, 0.99)[0])
            q = path_precision(len(times), kind, rho, 1 / rng.gamma(2.0, 1.0))
            out.append(precision_draw(rng, q, np.zeros(len(times))))
        return pd.DataFrame({"draw": np.repeat(pdf["draw"].to_numpy(), len(times)), "t": times * len(pdf), "value": np.concatenate(out)})

    draws = spark.range(n).select(F.col("id").cast("int").alias("draw"), F.pmod("id", F.lit(8)).alias("part"))
    made = draws.groupBy("part").applyInPandas(run, "draw int, t int, value double")
    return made.crossJoin(F.broadcast(terms)).select("term", F.lit(0).alias("chain"), "draw", "t", "value")


def prior_summary(spark: SparkSession, n_periods: int = 10, n: int = 1000, kind: str = "ar1", seed: int = 29) -> DataFrame:
    """(statistic, prob, value): what paths of the prior look like: largest step, roughness, range and trend."""
    from pyspark.sql import Window

    paths = prior_paths(spark.createDataFrame([("x",)], "term string"), range(n_periods), n, kind, seed)
    step = F.col("value") - F.lag("value").over(Window.partitionBy("draw").orderBy("t"))
    s = paths.withColumn("step", step)
    one = s.groupBy("draw").agg(F.max(F.abs("step")).alias("max_step"), F.avg(F.col("step") * F.col("step")).alias("roughness"), (F.max("value") - F.min("value")).alias("range"), F.regr_slope("value", F.col("t").cast("double")).alias("trend"))
    return summaries.quantiles(one.unpivot(["draw"], ["max_step", "roughness", "range", "trend"], "statistic", "value"), (0.05, 0.5, 0.95), ("statistic",))


def state_by_chain(fit: BayesFit) -> dict[int, pd.DataFrame]:
    """The stored state of each chain; its size is that of the model and not of the number of draws."""
    pdf = fit.state_table().where("block in ('beta', 'vc', 'a', 'b', 'u', 'v', 'g', 'latent_mean')").toPandas()
    return {int(c): g for c, g in pdf.groupby("chain")}


def restore(panel: Panel, options: Options, state: pd.DataFrame) -> dict:
    n, m, t_n = panel.shape
    out = {"beta": np.zeros((len(panel.names), t_n)), "a": np.zeros((n, t_n)), "b": np.zeros((m, t_n))}
    times = {t: k for k, t in enumerate(panel.periods)}
    rows, cols = ({x: k for k, x in enumerate(v)} for v in (panel.rows, panel.columns))
    at = lambda t: slice(None) if pd.isna(t) else times[int(t)]
    r = options.rank
    s = r if panel.square or options.rank_col is None else options.rank_col
    out |= {"u": np.zeros((n, r, t_n)), "v": np.zeros((m, s, t_n)), "g": np.repeat(np.eye(r, s)[:, :, None], t_n, 2), "z": np.nan_to_num(panel.y), "rho": np.zeros(t_n), "sab": np.eye(2)}
    names = {"rho_ab": "rho_ab", "sigma2_ab": "sig_ab", "rho_uv": "rho_uv", "sigma2_uv": "sig_uv", "pi_snap": "pi_snap", "ve": "s2"}
    for row in state.itertuples():
        if row.block == "beta":
            out["beta"][panel.names.index(row.term), at(row.t)] = row.value
        elif row.block in ("a", "b"):
            out[row.block][(rows if row.block == "a" else cols)[row.i], at(row.t)] = row.value
        elif row.block in ("u", "v"):
            out[row.block][(rows if row.block == "u" else cols)[row.i], int(row.term) - 1, at(row.t)] = row.value
        elif row.block == "g":
            x, y = map(int, row.term.split(","))
            out["g"][x - 1, y - 1, at(row.t)] = row.value
        elif row.block == "latent_mean":
            out["z"][rows[row.i], cols[row.j], times[int(row.t)]] = row.value
        elif row.term == "rho":
            out["rho"][at(row.t)] = row.value
        elif row.term in ("va", "cab", "vb"):
            k = {"va": (0, 0), "cab": (0, 1), "vb": (1, 1)}[row.term]
            out["sab"][k] = out["sab"][k[::-1]] = row.value
        elif row.term in names:
            out[names[row.term]] = row.value
        elif ":" in row.term:
            stem, name = row.term.split(":", 1)
            k = panel.names.index(name)
            out.setdefault("rho_beta", np.full(len(panel.names), 0.9))
            out.setdefault("sig_beta", np.full(len(panel.names), 0.1))
            square = float((panel.x[:, :, k] ** 2).mean()) or 1.0
            out["rho_beta" if stem == "rho_beta" else "sig_beta"][k] = row.value * (1.0 if stem == "rho_beta" else square)
    return out


# point estimates --------------------------------------------------------------------------------

ESTIMATES = "task int, block string, term string, t int, i string, j string, value double"


def als_rows(task: int, fit: Als) -> pd.DataFrame:
    """A point estimate as a long table."""
    from relata.plans.arrays import Draws

    out, p, o = Draws(task), fit.p, fit.o
    times = p.periods
    for k, name in enumerate(["intercept", *fit.names]):
        path = fit.mu_path if k == 0 else fit.beta[k - 1]
        if fit.moving[k] or (k == 0 and o.dynamic_ab):
            out.add(0, "beta", name, path, t=times)
        else:
            out.add(0, "beta", name, path.mean())
    vc = fit.components()
    out.add(0, "vc", list(vc), list(vc.values()))
    out.add(0, "fit", ["iterations", "converged", "sse"], [fit.iterations, float(fit.converged), fit.sse])
    for block, x, labels in (("a", fit.a, p.rows), ("b", fit.b, p.columns)):
        for t in range(len(times) if o.dynamic_ab else 1):
            out.add(0, block, block, x[:, t], t=times[t] if o.dynamic_ab else None, i=labels)
    for block, x, labels in (("u", fit.u, p.rows), ("v", fit.v, p.columns)):
        for t in range(len(times) if o.dynamic_uv else 1):
            for r in range(x.shape[1]):
                out.add(0, block, str(r + 1), x[:, r, t], t=times[t] if o.dynamic_uv else None, i=labels)
    if not p.square and fit.r:
        out.add(0, "g", [f"{r + 1},{s + 1}" for r in range(fit.r) for s in range(fit.s)], fit.g[:, :, 0])
    if o.dynamic_uv == "snap":
        for block, q, labels in (("snap_u", fit.q_u, p.rows), ("snap_v", fit.q_v, p.columns)):
            for t in range(1, len(times)):
                out.add(0, block, "snap", q[:, t], t=times[t], i=labels)
    cov = fit.sandwich()
    names = ["intercept", *fit.names]
    out.add(0, "vcov", [f"{a}|{b}" for a in names for b in names], cov)
    eta = fit.eta()
    i, j, t = np.nonzero(np.broadcast_to(~np.eye(fit.n, dtype=bool)[:, :, None] if p.square else True, p.shape))
    out.add(0, "eta", "eta", eta[i, j, t], t=[times[k] for k in t], i=[p.rows[k] for k in i], j=[p.columns[k] for k in j])
    return out.frame().drop(columns=["draw"]).rename(columns={"chain": "task"})


def point_fit(data: Data, options: AlsOptions | None = None, **settings) -> AlsFit:
    """A point estimate of a network or panel, static or moving, in one task."""
    options = options or AlsOptions(**settings)

    def fit(panel: Panel, task: dict) -> pd.DataFrame:
        return als_rows(0, best_of_starts(panel, options))

    rows = fan_out(data.dyads, chains(data.dyads.sparkSession, 1), data.names, fit, ESTIMATES, data.square)
    return AlsFit(data, options, written(rows, "als"))


@dataclass
class AlsFit:
    data: Data
    options: AlsOptions
    table: DataFrame
    replicates: DataFrame | None = None

    def block(self, name: str) -> DataFrame:
        return self.table.where(F.col("block") == name)

    def coef(self) -> DataFrame:
        return self.block("beta").select("term", "t", F.col("value").alias("estimate"))

    def vcov(self) -> DataFrame:
        if self.replicates is not None:
            return summaries.covariances(self.replicates.where("block = 'beta'").select(F.lit(0).alias("chain"), F.col("task").alias("draw"), "term", "value"))
        return self.block("vcov").select(F.split("term", r"\|")[0].alias("term_a"), F.split("term", r"\|")[1].alias("term_b"), "value")

    def tidy(self, level: float = 0.95) -> DataFrame:
        """Estimates with replicated or sandwich errors and intervals."""
        from statistics import NormalDist

        from relata.functions.distributions import two_sided_p

        se = self.vcov().where("term_a = term_b").select(F.col("term_a").alias("term"), F.sqrt(F.greatest("value", F.lit(0.0))).alias("std_error"))
        z = F.try_divide("estimate", "std_error")
        half = NormalDist().inv_cdf(0.5 + level / 2) * F.col("std_error")
        return self.coef().join(se, "term", "left").select("term", "t", "estimate", "std_error", z.alias("statistic"), two_sided_p(z).alias("p_value"), (F.col("estimate") - half).alias("conf_low"), (F.col("estimate") + half).alias("conf_high"))

    def confint(self, level: float = 0.95) -> DataFrame:
        return self.tidy(level).select("term", "t", "conf_low", "conf_high")

    def predict(self, kind: str = "response") -> DataFrame:
        eta = self.block("eta").select("t", "i", "j", F.col("value").alias("eta"))
        value = F.col("eta") if kind == "link" else inverse_link(self.options.family, F.col("eta"), self.options.link)
        return eta.select("t", "i", "j", value.alias("value"))

    fitted = predict

    def residuals(self) -> DataFrame:
        return self.data.dyads.select("t", "i", "j", "y").join(self.fitted(), ["t", "i", "j"]).select("t", "i", "j", (F.col("y") - F.col("value")).alias("residual"))

    def nobs(self) -> int:
        return self.data.dyads.agg(F.count("y")).first()[0]

    def glance(self) -> DataFrame:
        vc = self.table.where("block in ('vc', 'fit')").groupBy().pivot("term", ["va", "vb", "cab", "rho", "ve", "iterations", "converged"]).agg(F.first("value"))
        return vc.select("*", F.lit(self.options.family).alias("family"), F.lit(self.options.rank).alias("rank"), F.lit(self.nobs()).alias("nobs"))

    def bootstrap(self, n: int = 100, kind: str = "parametric", block: int = 1, batches: int = 32) -> AlsFit:
        """Replicated fits in batches, one task each, which makes the base fit anew rather than ship it."""
        options, batches = self.options, min(n, batches)

        def fit(panel: Panel, task: dict) -> pd.DataFrame:
            base = best_of_starts(panel, options)
            parts = [als_rows(k, bootstrap_replicate(panel, options, base, k, kind, block)) for k in range(int(task["task"]), n, batches)]
            rows = pd.concat(parts, ignore_index=True)
            return rows[rows["block"].isin(["beta", "vc", "a", "b"])]

        rows = fan_out(self.data.dyads, chains(self.data.dyads.sparkSession, batches), self.data.names, fit, ESTIMATES, self.data.square)
        return AlsFit(self.data, options, self.table, written(rows, "replicates"))

    def bootstrap_interval(self, level: float = 0.95, kind: str = "percentile") -> DataFrame:
        if self.replicates is None:
            raise NotAvailable("no replicates; call bootstrap first")
        q = summaries.intervals(self.replicates.where("block = 'beta'"), level)
        if kind == "percentile":
            return q
        est = self.coef().groupBy("term").agg(F.avg("estimate").alias("e"))
        return q.join(est, "term").select("term", (2 * F.col("e") - F.col("conf_high")).alias("conf_low"), (2 * F.col("e") - F.col("conf_low")).alias("conf_high"))

    def simulate(self, n: int = 1, seed: int = 29) -> DataFrame:
        options = replace(self.options, seed=seed)

        def fit(panel: Panel, task: dict) -> pd.DataFrame:
            k = int(task["task"])
            y = best_of_starts(panel, options).simulate(np.random.default_rng([seed, 2, k]))
            i, j, t = np.nonzero(~np.isnan(y))
            return pd.DataFrame({"task": k, "t": np.array(panel.periods)[t], "i": np.array(panel.rows)[i], "j": np.array(panel.columns)[j], "value": y[i, j, t]})

        return fan_out(self.data.dyads, chains(self.data.dyads.sparkSession, n), self.data.names, fit, "task int, t int, i string, j string, value double", self.data.square)

    def refit(self, y: DataFrame) -> AlsFit:
        """The same model for other responses (t, i, j, y)."""
        other = self.data.dyads.drop("y").join(y.select("t", "i", "j", "y"), ["t", "i", "j"], "left").select(*self.data.dyads.columns)
        return point_fit(Data(other, self.data.names, self.data.square), self.options)

    def update(self, **changes) -> AlsFit:
        return point_fit(self.data, replace(self.options, **changes))

    def loo(self):
        raise NotAvailable("a point estimate has no draws")

    waic = log_lik = loo

    def node_decomposition(self, nodes: DataFrame, names: Sequence[str], side: str = "row") -> DataFrame:
        """(term, estimate): mean effects regressed on an intercept and nodal covariates."""
        from relata.operators.regression import least_squares

        e = self.block("a" if side == "row" else "b").groupBy(F.col("i").alias("actor")).agg(F.avg("value").alias("y"))
        x = e.join(nodes.select("actor", *names), "actor").withColumn("one", F.lit(1.0))
        found = least_squares(x, ["one", *names])[()]
        return nodes.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(["intercept", *names], found)], "term string, estimate double")

    def stability(self, starts: int = 2) -> DataFrame:
        """Largest difference of the fitted surface between this fit and refits from other starts."""
        base = self.block("eta").select("t", "i", "j", F.col("value").alias("x"))
        out = None
        for k in range(1, starts + 1):
            other = self.update(seed=self.options.seed + 7919 * k, starts=2).block("eta").select("t", "i", "j", F.col("value").alias("z"))
            one = base.join(other, ["t", "i", "j"]).agg(F.lit(k).alias("start"), F.max(F.abs(F.col("x") - F.col("z"))).alias("max_difference"), F.corr("x", "z").alias("correlation"), F.sqrt(F.avg((F.col("x") - F.col("z")) ** 2)).alias("rmse"))
            out = one if out is None else out.unionByName(one)
        return out

    def snap_changes(self, top: int = 10) -> DataFrame:
        """Actor-periods by their reset responsibility, with the step of the position."""
        from pyspark.sql import Window

        pos = self.table.where("block in ('u', 'v') and t is not null").select("block", F.col("i").alias("actor"), "term", "t", "value")
        step = pos.withColumn("d", F.col("value") - F.lag("value").over(Window.partitionBy("block", "actor", "term").orderBy("t")))
        steps = step.groupBy(F.concat(F.lit("snap_"), "block").alias("block"), "actor", "t").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("step"))
        q = self.table.where("block in ('snap_u', 'snap_v')").select("block", F.col("i").alias("actor"), "t", F.col("value").alias("q"))
        return q.join(steps, ["block", "actor", "t"], "left").orderBy(F.desc("q"), F.desc("step"), "block", "actor", "t").limit(top)


# across fits ------------------------------------------------------------------------------------

def pooled_fits(panels: DataFrame, names: Sequence[str], options: Options, square: bool = True) -> DataFrame:
    """Fits of several panels (a column `panel`), one task each, pooled by inverse variance."""
    ids = panels.select("panel").distinct()
    from pyspark.sql import Window

    tasks = ids.withColumn("task", (F.row_number().over(Window.orderBy("panel")) - 1).cast("int"))

    def fit(panel: Panel, task: dict) -> pd.DataFrame:
        return Chain(panel, replace(options, seed=options.seed + SEED_STEP * int(task["task"])), int(task["task"])).run().frame()

    draws = written(fan_out(panels, tasks, names, fit, DRAWS, square), "panels")
    one = draws.where("block = 'beta'").join(F.broadcast(tasks.withColumnRenamed("task", "chain")), "chain")
    fits = one.groupBy("panel", "term").agg(F.avg("value").alias("estimate"), F.stddev_samp("value").alias("std_error"))
    return summaries.pooled(fits)


def leave_future_out(data: Data, options: Options, periods: Sequence[int] | None = None) -> DataFrame:
    """(period, elpd, n): one-step densities of each held-out period from a fit to those before, as log mean of draws; one task per split."""
    known = [r.t for r in data.dyads.select("t").distinct().orderBy("t").collect()]
    splits = list(periods or known[-3:])
    if any(known.index(s) < 1 for s in splits):
        raise ValueError("a split needs a period before it")
    tasks = data.dyads.sparkSession.createDataFrame([(k, int(s)) for k, s in enumerate(splits)], "task int, split int")

    def fit(panel: Panel, task: dict) -> pd.DataFrame:
        s = panel.periods.index(int(task["split"]))
        past = Panel(panel.y[:, :, :s], panel.x[:, :, :, :s], panel.rows, panel.columns, panel.periods[:s], panel.names, panel.square)
        chain = Chain(past, replace(options, keep_gof=False, keep_loglik=False, seed=options.seed + int(task["task"])))
        now, total, n = panel.y[:, :, s : s + 1], [], 0
        for sweep in range(options.burn + options.scan):
            chain.sweep()
            if sweep >= options.burn and (sweep - options.burn) % options.thin == 0:
                beta, (a, b) = chain.coefficients_ahead(), chain.additive_ahead()
                eta = np.einsum("ijk,k->ij", panel.x[:, :, :, s], beta) + a[:, None] + b[None, :] + chain.multiplicative_ahead() + chain.slopes_ahead(panel.x[:, :, :, s])
                total.append(pointwise(now, eta[:, :, None], options.family, chain.s2)[:, :, 0])
        ll = np.stack(total)
        top = np.nanmax(ll, axis=0)
        density = top + np.log(np.mean(np.exp(ll - top), axis=0))
        seen = ~np.isnan(now[:, :, 0])
        return pd.DataFrame({"task": [int(task["task"])], "period": [int(task["split"])], "elpd": [float(density[seen].sum())], "n": [int(seen.sum())]})

    return fan_out(data.dyads, tasks, data.names, fit, "task int, period int, elpd double, n long", data.square).drop("task")


def per_actor_slopes(residual: DataFrame, covariate: str, side: str = "row", penalty: float = 1.0) -> DataFrame:
    """(actor, t, slope): each actor's path of a covariate's slope on residuals, under a penalty on its steps; one solve per actor."""
    at = "i" if side == "row" else "j"
    sums = residual.where("residual is not null").groupBy(F.col(at).alias("actor"), "t").agg(F.sum(F.col(covariate) ** 2).alias("xx"), F.sum(F.col(covariate) * F.col("residual")).alias("xr"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        n = len(pdf)
        step = np.diff(np.eye(n), axis=0)
        a = np.diag(pdf["xx"].to_numpy()) + penalty * step.T @ step + 1e-8 * np.eye(n)
        return pd.DataFrame({"actor": pdf["actor"], "t": pdf["t"], "slope": np.linalg.solve(a, pdf["xr"].to_numpy())})

    return sums.groupBy("actor").applyInPandas(one, "actor string, t int, slope double")


def forecast_pit(fit: BayesFit, future: DataFrame, h: int = 1, discrete: bool | None = None, seed: int = 29) -> DataFrame:
    """Calibration of h-step forecasts of the observed future (i, j, y)."""
    draws = fit.forecast(h, by_draw=True, kind="link", seed=seed).where(F.col("h") == h)
    ve = fit.block("vc").where("term = 've'").select("chain", "draw", F.col("value").alias("ve"))
    z = draws.join(ve, ["chain", "draw"]).withColumn("z", F.col("value") + F.sqrt("ve") * hash_normal("chain", "draw", "i", "j", F.lit(seed)))
    f = fit.options.family
    value = (F.col("z") > 0).cast("double") if f == "binary" else F.exp(F.least("z", F.lit(14.0))) if f == "poisson" else F.col("z")
    made = z.select("i", "j", value.alias("value"))
    return evaluation.pit_summary(evaluation.pit(made, future, f != "normal" if discrete is None else discrete, ("i", "j"), seed))


def probability(eta: DataFrame) -> DataFrame:
    return eta.withColumn("value", normal_cdf(F.col("value")))


def memory_estimate(n_row: int, n_col: int | None = None, periods: int = 1, covariates: int = 1, rank: int = 2, draws: int = 100) -> dict[str, int]:
    """Bytes of one task of a fit: the panel's arrays, working surfaces, and kept draws."""
    cells = n_row * (n_col or n_row) * periods
    out = {"panel": 8 * cells * (1 + covariates), "work": 8 * cells * 6, "draws": 60 * draws * (n_row + (n_col or n_row)) * (1 + rank)}
    return out | {"total": sum(out.values())}
