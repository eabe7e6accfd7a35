"""Additive and low-rank models of networks that no worker holds, by alternating least squares over tables.

    eta_ij = x_ij' beta + a_i + b_j + u_i' v_j

Layout. Cells lie in tiles, a hash block of senders by a hash block of receivers,
so a sender with a third of all cells is spread over all blocks of receivers;
a tile that is still too large is cut by a hash of its cells. The cells are
written once in buckets by tile and are never shuffled again. For each side a routing
table lists which actors a tile needs, and under which number.

Half sweep. The other side's positions go to the tiles that need them, as one
flat array a tile, of bounded length; cells look their actor up by number, and each
actor's normal equations, of the size of the rank, are summed in the tiles, then over
them. Effect and factors of an actor are solved together. What is shuffled is
one row for each actor and tile. Coefficients take one more pass of p sums. Positions
are written every half sweep, so a lost executor costs half a sweep.

Other families reweight: the working response and weights are written for each
outer step, the best iterate is kept, and a step that raises the penalised deviance is halved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.functions.linear import safe_solve
from relata.functions.links import deviance_column, working_columns
from relata.operators.bootstrap import bootstrap_draws
from relata.session import bucketed, written

#: Cells of a tile and actors of a block, about; tiles that may be cut, at most; buckets, at most.
TILE_CELLS = 2_000_000
BLOCK_ACTORS = 50_000
CUT_TILES = 10_000
BUCKETS = 20_000


@dataclass
class Tiles:
    """Cells in buckets of their tile, and the actors of each side that a tile needs, numbered from 0."""

    cells: DataFrame
    rows: DataFrame
    columns: DataFrame
    buckets: int

    def actors(self, side: str) -> DataFrame:
        return getattr(self, side).select("actor").distinct()


def lay_out(cells: DataFrame, keep: list[str], tile_cells: int = TILE_CELLS, block_actors: int = BLOCK_ACTORS) -> Tiles:
    """Tiles of (i, j, *keep)."""
    spark = cells.sparkSession
    cells = written(cells.select("i", "j", *keep), "cells")
    n, rows, columns = cells.agg(F.count("*"), F.approx_count_distinct("i"), F.approx_count_distinct("j")).first()
    # Spark reads buckets as such only if they are no fewer than the partitions of a shuffle.
    least = max(spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS))
    side = math.sqrt(max(n / tile_cells, least))
    p, q = (max(1, math.ceil(min(side, k)), math.ceil(k / block_actors)) for k in (rows, columns))
    tile = F.pmod(F.xxhash64("i"), F.lit(p)) * q + F.pmod(F.xxhash64("j"), F.lit(q))
    placed = cells.withColumn("tile", tile)
    # Fewer than CUT_TILES tiles can hold that many cells, so their list is bounded.
    large = placed.groupBy("tile").count().where(F.col("count") > max(4 * tile_cells, n // CUT_TILES)).select("tile", F.ceil(F.col("count") / tile_cells).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("i", "j", *keep), F.col("parts")), F.lit(0))
    cut = placed.join(F.broadcast(large), "tile", "left").withColumn("tile", F.col("tile") * (1 << 20) + part).drop("parts")

    def route(actor: str) -> DataFrame:
        number = F.row_number().over(Window.partitionBy("tile").orderBy("actor")) - 1
        return written(cut.select("tile", F.col(actor).alias("actor")).distinct().withColumn("l", number), "route")

    to_rows, to_columns = route("i"), route("j")
    numbered = cut.join(to_rows.select("tile", F.col("actor").alias("i"), F.col("l").alias("il")), ["tile", "i"]).join(to_columns.select("tile", F.col("actor").alias("j"), F.col("l").alias("jl")), ["tile", "j"])
    buckets = min(max(p * q, least), BUCKETS)
    return Tiles(bucketed(numbered.repartition(buckets, "tile"), "tiles", "tile", buckets), to_rows, to_columns, buckets)


def gathered(route: DataFrame, positions: DataFrame, name: str) -> DataFrame:
    """(tile, name): the positions that a tile needs, one after the other in a flat array."""
    per_tile = route.join(positions, "actor").groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("l", "position"))).alias("p"))
    return per_tile.select("tile", F.flatten(F.transform("p", lambda s: s["position"])).alias(name)).hint("shuffle_hash")


def _entry(array: str, number: str, width: int, k: int) -> Column:
    return F.get(F.col(array), F.col(number) * width + k)


def _linear(names: list[str], beta: np.ndarray) -> Column:
    total = F.lit(0.0)
    for n, b in zip(names, beta):
        total = total + F.lit(float(b)) * F.col(n)
    return total


@dataclass
class State:
    """Coefficients, and (actor, position) of both sides; a position is the effect and then the factors."""

    beta: np.ndarray
    rows: DataFrame
    columns: DataFrame
    ridge: dict[str, np.ndarray] = field(default_factory=dict)

    def towards(self, other: State) -> State:
        """The point half way."""
        mid = lambda a, b: written(a.join(b.withColumnRenamed("position", "q"), "actor").select("actor", F.zip_with("position", "q", lambda x, y: (x + y) / 2).alias("position")), "positions")
        return State((self.beta + other.beta) / 2, mid(self.rows, other.rows), mid(self.columns, other.columns), other.ridge)


def start(actors: DataFrame, rank: int, seed: int, zero: bool) -> DataFrame:
    """Effects of zero and factors between -1 and 1 by the MD5 of seed, number of the factor and actor, or zero."""
    uniform = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.col("actor").cast("string"))), 1, 8), 16, 10).cast("double") / 2**31 - 1
    return written(actors.withColumn("position", F.array(F.lit(0.0), *[F.lit(0.0) if zero else uniform(k) for k in range(rank)])), "positions")


def half_sweep(tiles: Tiles, side: str, state: State, names: list[str], rank: int, z: str, w: str | None) -> tuple[DataFrame, float, float]:
    """(actor, position, spread) of one side given the other: exact minimisers, and the diagonal of each inverse; the mean effect, and the penalty.

    The last two are observed while the positions are written, so they take no job of their own.
    """
    own, other, number = ("i", "columns", "jl") if side == "rows" else ("j", "rows", "il")
    width, weight = rank + 1, F.col(w) if w else F.lit(1.0)
    cells = tiles.cells.join(gathered(getattr(tiles, other), getattr(state, other), "far"), "tile")
    cells = cells.select(own, weight.alias("w"), (F.col(z) - _linear(names, state.beta) - _entry("far", number, width, 0)).alias("e"), *[_entry("far", number, width, k).alias(f"c{k}") for k in range(1, width)])
    terms = [F.lit(1.0), *[F.col(f"c{k}") for k in range(1, width)]]
    upper = [(a, b) for a in range(width) for b in range(a, width)]
    sums = [F.sum(F.col("w") * terms[a] * terms[b]).alias(f"s{a}_{b}") for a, b in upper] + [F.sum(F.col("w") * terms[a] * F.col("e")).alias(f"r{a}") for a in range(width)]
    ridge = np.concatenate([[0.0], state.ridge[side]])
    schema = T.StructType([T.StructField("actor", cells.schema[own].dataType), *T.StructType.fromDDL("position array<double>, spread array<double>").fields])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            a, r = np.zeros((batch.num_rows, width, width)), np.stack([column(f"r{k}") for k in range(width)], 1)
            for x, y in upper:
                a[:, x, y] = a[:, y, x] = column(f"s{x}_{y}")
            a += np.diag(ridge)
            a[a[:, 0, 0] == 0, 0, 0] = 1.0
            inverse = np.linalg.inv(a)
            position = np.linalg.solve(a, r[:, :, None])[:, :, 0]
            spread = np.einsum("nkk->nk", inverse)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), width).cast(pa.list_(pa.float64())) for x in (position, spread)]
            yield pa.RecordBatch.from_arrays([batch.column("actor"), *lists], names=["actor", "position", "spread"])

    solved = cells.groupBy(F.col(own).alias("actor")).agg(*sums).mapInArrow(solve, schema)
    seen, entry = Observation(), lambda k: F.get("position", F.lit(k))
    squares = sum((float(r) * entry(k + 1) * entry(k + 1) for k, r in enumerate(state.ridge[side])), F.lit(0.0))
    out = written(solved.observe(seen, F.avg(entry(0)).alias("mean"), F.sum(squares).alias("penalty")), "positions")
    return out, seen.get["mean"] or 0.0, seen.get["penalty"] or 0.0


def centred(positions: DataFrame, mean: float) -> DataFrame:
    """Effects less their mean over the actors; the intercept takes the mean up at its next update."""
    return positions.select("actor", F.transform("position", lambda x, k: F.when(k == 0, x - mean).otherwise(x)).alias("position"))


def with_eta(tiles: Tiles, state: State, names: list[str], rank: int) -> DataFrame:
    """The tiles' cells with eta, their linear predictor, and base, what it is without coefficients."""
    width, kept = rank + 1, tiles.cells.columns
    # A join hands each cell on with all its columns, so a tile's array must not outlive its own join.
    near = tiles.cells.join(gathered(tiles.rows, state.rows, "near"), "tile").select(*kept, *[_entry("near", "il", width, k).alias(f"_n{k}") for k in range(width)])
    base = F.col("_n0") + _entry("far", "jl", width, 0)
    for k in range(1, width):
        base = base + F.col(f"_n{k}") * _entry("far", "jl", width, k)
    both = near.join(gathered(tiles.columns, state.columns, "far"), "tile").select(*kept, base.alias("base"))
    return both.withColumn("eta", F.col("base") + _linear(names, state.beta))


def penalty(state: State, rank: int) -> float:
    total = 0.0
    if rank:
        for side in ("rows", "columns"):
            sums = getattr(state, side).agg(*[F.sum(F.pow(F.get("position", F.lit(k)), 2)) for k in range(1, rank + 1)]).first()
            total += float(np.dot(state.ridge[side], [s or 0.0 for s in sums]))
    return total


def _weighted_products(cells: DataFrame, names: list[str], z: Column, w: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """X'WX, X'Wz and z'Wz."""
    p = len(names)
    upper = [(a, b) for a in range(p) for b in range(a, p)]
    x = [F.col(n) for n in names]
    sums = cells.agg(*[F.sum(w * x[a] * x[b]) for a, b in upper], *[F.sum(w * x[a] * z) for a in range(p)], F.sum(w * z * z)).first()
    xx = np.zeros((p, p))
    for (a, b), s in zip(upper, sums):
        xx[a, b] = xx[b, a] = s or 0.0
    return xx, np.array([s or 0.0 for s in sums[len(upper) : -1]]), float(sums[-1] or 0.0)


def _sweeps(tiles: Tiles, state: State, names: list[str], rank: int, z: str, w: str | None, sweeps: int, tol: float, centre: bool) -> tuple[State, float, int, bool]:
    """State, penalised objective, sweeps made, and whether the objective has settled."""
    last, objective, done, weight = np.inf, np.inf, 0, F.col(w) if w else F.lit(1.0)
    for done in range(1, sweeps + 1):
        penalties = 0.0
        for side in ("rows", "columns"):
            solved, mean, part = half_sweep(tiles, side, state, names, rank, z, w)
            setattr(state, side, centred(solved, mean) if centre else solved.select("actor", "position"))
            penalties += part
        xx, xz, zz = _weighted_products(with_eta(tiles, state, names, rank), names, F.col(z) - F.col("base"), weight)
        state.beta = safe_solve(xx, xz)
        objective = zz - 2 * float(state.beta @ xz) + float(state.beta @ xx @ state.beta) + penalties
        if abs(last - objective) <= tol * (abs(objective) + 1e-12):
            return state, objective, done, True
        last = objective
    return state, objective, done, False


def _empirical_ridge(tiles: Tiles, state: State, names: list[str], rank: int, z: str, w: str, scale: float) -> dict[str, np.ndarray]:
    """Precisions of the factors by one step of expectation and maximisation under an inverse-gamma prior with mean `scale`.

    The second moment of a factor is its square and its variance given the other side.
    """
    out = {}
    for side in ("rows", "columns"):
        spread = half_sweep(tiles, side, state, names, rank, z, w)[0].select("actor", "spread")
        both = getattr(state, side).join(spread, "actor")
        moment = lambda k: F.sum(F.pow(F.get("position", F.lit(k)), 2) + F.get("spread", F.lit(k)))
        n, *sums = both.agg(F.count("*"), *[moment(k) for k in range(1, rank + 1)]).first()
        out[side] = (n + 2 * rank + 2) / (scale + np.array([s or 0.0 for s in sums]))
    return out


@dataclass
class BlockFit:
    """Coefficients; (actor, effect, position) of both sides; the penalised objective: squares, or the deviance of other families."""

    beta: dict[str, float]
    rows: DataFrame
    columns: DataFrame
    objective: float
    trace: list[float]
    sweeps: int
    converged: bool
    family: str = "normal"

    def predict(self, cells: DataFrame, name: str = "eta") -> DataFrame:
        """Cells (i, j and covariates) with their linear predictor; actors without a position have effect and factors of zero."""
        a = self.rows.select(F.col("actor").alias("i"), F.col("effect").alias("_a"), F.col("position").alias("_u"))
        b = self.columns.select(F.col("actor").alias("j"), F.col("effect").alias("_b"), F.col("position").alias("_v"))
        product = F.coalesce(F.aggregate(F.zip_with("_u", "_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
        eta = _linear(list(self.beta), np.array(list(self.beta.values()))) + F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0)) + product
        return cells.join(a, "i", "left").join(b, "j", "left").withColumn(name, eta).drop("_a", "_u", "_b", "_v")

    def bootstrap(self, cells: DataFrame, replicates: int = 200, block: tuple[str, ...] = ("i",), scheme: str = "exponential", seed: int = 17) -> DataFrame:
        """(replicate, term, value) of the coefficients, given effects and factors; the panel is read once for all replicates.

        For other families than the normal it is one reweighted step from the fit.
        """
        held = self.predict(cells, "_eta")
        base = F.col("_eta") - _linear(list(self.beta), np.array(list(self.beta.values())))
        z, w = (F.col("y"), F.lit(1.0)) if self.family == "normal" else working_columns(F.col("y"), F.col("_eta"), self.family)
        return bootstrap_draws(held.withColumn("_rest", z - base).withColumn("_weight", w), list(self.beta), replicates, block, "_rest", F.col("_weight"), scheme, seed)

    def residuals(self, cells: DataFrame, name: str = "residual") -> DataFrame:
        return self.predict(cells, "_eta").withColumn(name, F.col("y") - F.col("_eta")).drop("_eta")


def _balanced(state: State, rank: int) -> tuple[DataFrame, DataFrame]:
    """Effects and factors with equal, diagonal and falling second moments on both sides; u'v is unchanged."""
    split = lambda t, m: t.select("actor", F.get("position", F.lit(0)).alias("effect"), F.array(*[sum((F.lit(float(m[k, c])) * F.get("position", F.lit(k + 1)) for k in range(rank)), F.lit(0.0)) for c in range(rank)]).cast("array<double>").alias("position"))
    if not rank:
        return split(state.rows, np.zeros((0, 0))), split(state.columns, np.zeros((0, 0)))
    roots = []
    for t in (state.rows, state.columns):
        sums = t.agg(*[F.sum(F.get("position", F.lit(a + 1)) * F.get("position", F.lit(b + 1))) for a in range(rank) for b in range(rank)]).first()
        values, vectors = np.linalg.eigh(np.array([s or 0.0 for s in sums]).reshape(rank, rank))
        roots.append((vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T)
    p, d, q = np.linalg.svd(roots[0] @ roots[1])
    sides = [np.linalg.pinv(root) @ m * np.sqrt(d) for root, m in zip(roots, (p, q.T))]
    sign = np.where(sides[0][np.abs(sides[0]).argmax(0), np.arange(rank)] < 0, -1.0, 1.0)
    return split(state.rows, sides[0] * sign), split(state.columns, sides[1] * sign)


def block_fit(
    cells: DataFrame, names: list[str], rank: int = 0, family: str = "normal", weight: str | None = None, ridge: float | str = 1e-3, sweeps: int = 50, tol: float = 1e-8, outer: int = 10, halvings: int = 6, seed: int = 29,
    prior_scale: float = 1.0, tile_cells: int = TILE_CELLS, block_actors: int = BLOCK_ACTORS,
) -> BlockFit:
    """A fit of y on the named columns (`intercept` among them to have centred effects), effects and factors.

    family: normal, poisson (log link) or binary (logit link). ridge: the precision of factors, above 0, or
    "empirical" for one per factor and side that follows the data and `prior_scale`. Cells with a null response or covariate are
    left out. `sweeps` bounds those of each outer step, `outer` the reweightings; `tol` is a relative change.
    """
    if family not in ("normal", "poisson", "binary"):
        raise ValueError("family is normal, poisson or binary")
    if rank and ridge != "empirical" and not float(ridge) > 0:
        raise ValueError("factors need a ridge above 0")
    keep = ["y", *names, *([weight] if weight else [])]
    seen = cells.where(F.col("y").isNotNull())
    for n in keep[1:]:
        seen = seen.where(F.col(n).isNotNull())
    tiles = lay_out(seen, keep, tile_cells, block_actors)
    centre = "intercept" in names
    state = State(np.zeros(len(names)), start(tiles.actors("rows"), rank, seed, True), start(tiles.actors("columns"), rank, seed, False))
    state.ridge = {side: np.full(rank, 1.0 if ridge == "empirical" else float(ridge)) for side in ("rows", "columns")}
    if family == "normal":
        w = F.col(weight) if weight else F.lit(1.0)
        xx, xy, _ = _weighted_products(tiles.cells, names, F.col("y"), w)
        state.beta = safe_solve(xx, xy)
        state, objective, done, settled = _sweeps(tiles, state, names, rank, "y", weight, sweeps, tol, centre)
        rows, columns = _balanced(state, rank)
        return BlockFit(dict(zip(names, map(float, state.beta))), rows, columns, objective, [objective], done, settled, family)

    mean = tiles.cells.agg(F.avg("y")).first()[0] or 0.0
    if centre:
        state.beta[names.index("intercept")] = math.log(max(mean, 1e-12)) if family == "poisson" else math.log(max(mean, 1e-12) / max(1 - mean, 1e-12))
    times = F.col(weight) if weight else F.lit(1.0)

    half_way = (F.col("y") + F.lit(float(mean))) / 2
    link_of_start = F.log(half_way) if family == "poisson" else F.log(half_way / (1 - half_way))

    def reweighted(at: State, begin: bool = False) -> tuple[Tiles, float]:
        """Tiles with working response and weight at this state, and its deviance; at the beginning, weights at means half way to the data."""
        z, w = working_columns(F.col("y"), link_of_start if begin else F.col("eta"), family)
        table = with_eta(tiles, at, names, rank).withColumns({"_z": z, "_w": w * times, "_d": deviance_column(F.col("y"), F.col("eta"), family) * times}).drop("base", "eta")
        table = bucketed(table, "work", "tile", tiles.buckets)
        return Tiles(table, tiles.rows, tiles.columns, tiles.buckets), float(table.agg(F.sum("_d")).first()[0] or 0.0)

    work, deviance = reweighted(state, True)
    held = 0.0  # the penalty of the best state: products are zero at first, as those of no factors
    trace, done, settled = [deviance], 0, False
    for k in range(outer):
        if rank and ridge == "empirical":
            state.ridge = _empirical_ridge(work, state, names, rank, "_z", "_w", prior_scale)
            held = penalty(state, rank) if k else 0.0
        best = deviance + held
        step, _, made, _ = _sweeps(work, State(state.beta.copy(), state.rows, state.columns, state.ridge), names, rank, "_z", "_w", sweeps, tol, centre)
        done += made
        next_work, value = reweighted(step)
        for _ in range(halvings):
            if math.isfinite(value) and value + penalty(step, rank) <= best:
                break
            step = state.towards(step)
            next_work, value = reweighted(step)
        after = penalty(step, rank)
        if not (math.isfinite(value) and value + after <= best):
            break
        state, work, deviance, held = step, next_work, value, after
        trace.append(deviance + held)
        if best - trace[-1] <= tol * (abs(trace[-1]) + 1e-12):
            settled = True
            break
    best = deviance + held
    rows, columns = _balanced(state, rank)
    return BlockFit(dict(zip(names, map(float, state.beta))), rows, columns, best, trace, done, settled, family)
