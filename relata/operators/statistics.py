"""Network statistics of dyad tables, as group-bys and equi joins per network.

`by` names the columns that tell networks apart (a period, or a draw and a
period); a network's cells are its rows, and null cells are unobserved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.session import written

By = Sequence[str]

#: Actors of a block where networks are full.
GRID_BLOCK = 1024
#: Partners in one array, at most.
CHUNK = 1024


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of rows where both are known; null, and no error, where either is constant."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def transposed(dyads: DataFrame, name: str = "y_back", value: str = "y", by: By = ("t",)) -> DataFrame:
    """dyads with the value of the opposite pair; null where that is missing."""
    back = dyads.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias(name))
    return dyads.join(back, [*by, "i", "j"], "left")


def symmetrized(dyads: DataFrame, by: By = ("t",)) -> DataFrame:
    """Both directions get the mean of the observed ones."""
    both = transposed(dyads, "_b", "y", by)
    return both.withColumn("y", F.coalesce((F.col("y") + F.col("_b")) / 2, F.col("y"), F.col("_b"))).drop("_b")


def degrees(dyads: DataFrame, by: By = ("t",)) -> DataFrame:
    """(by, actor, side, degree, total): non-zero ties and their sum, for rows and for columns."""
    tie = F.sum(F.when(F.col("y") != 0, 1).otherwise(0)).cast("long").alias("degree")
    sides = [dyads.groupBy(*by, F.col(c).alias("actor")).agg(tie, F.coalesce(F.sum("y"), F.lit(0.0)).alias("total")).withColumn("side", F.lit(s)) for c, s in (("i", "row"), ("j", "col"))]
    return sides[0].unionByName(sides[1]).select(*by, "actor", "side", "degree", "total")


def heterogeneity(dyads: DataFrame, by: By = ("t",)) -> DataFrame:
    """(by, sd_row, sd_col): standard deviation of the row and of the column means of observed cells."""
    ends = F.explode(F.array(F.struct(F.lit(True).alias("row"), F.col("i").alias("actor")), F.struct(F.lit(False).alias("row"), F.col("j").alias("actor"))))
    means = dyads.select(*by, "y", ends.alias("end")).groupBy(*by, "end").agg(F.avg("y").alias("m"))
    row = F.col("end.row")
    return means.groupBy(*by).agg(F.stddev_samp(F.when(row, F.col("m"))).alias("sd_row"), F.stddev_samp(F.when(~row, F.col("m"))).alias("sd_col"))


def edge_heterogeneity(edges: DataFrame, by: By = ("t",)) -> DataFrame:
    """`heterogeneity` of edges of two modes on their full spine, all actors of all networks, without making it: a mean is a sum over the number of the other side.

    Of repeated edges the largest counts. Actors without an edge in a network have a mean of zero, which is put to the spread of the others' means.
    """
    by = list(by)
    one = edges.where("i is not null and j is not null").groupBy(*by, "i", "j").agg(F.max("y").cast("double").alias("y"))
    n = {c: edges.select(c).distinct().count() for c in ("i", "j")}
    out = edges.select(*by).distinct()
    for c, other, name in (("i", "j", "sd_row"), ("j", "i", "sd_col")):
        means = one.groupBy(*by, c).agg((F.coalesce(F.sum("y"), F.lit(0.0)) / n[other]).alias("m"))
        spread = means.groupBy(*by).agg(F.count("*").alias("k"), F.avg("m").alias("m"), F.var_pop("m").alias("v"))
        squares = F.col("k") * F.col("v") + F.col("m") * F.col("m") * F.col("k") * (n[c] - F.col("k")) / n[c]
        sd = F.sqrt(F.coalesce("squares", F.lit(0.0)) / (n[c] - 1)) if n[c] > 1 else F.lit(None).cast("double")
        out = out.join(spread.select(*by, squares.alias("squares")), by, "left").withColumn(name, sd).drop("squares")
    return out


def pairs_of(dyads: DataFrame, by: By = ("t",)) -> DataFrame:
    """(by, lo, hi, f, g): the observed cells of each unordered pair, f from the lesser to the greater actor and g back; null where unobserved."""
    cells = dyads.where("y is not null and i <> j")
    up = F.col("i") < F.col("j")
    ends = cells.select(*by, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.when(up, F.col("y")).alias("f"), F.when(~up, F.col("y")).alias("g"))
    return ends.groupBy(*by, "lo", "hi").agg(F.max("f").alias("f"), F.max("g").alias("g"))


def reciprocity(dyads: DataFrame, by: By = ("t",), pairs: DataFrame | None = None) -> DataFrame:
    """(by, dyad_dep): correlation of the cells with those of the opposite pairs; actors with themselves take no part."""
    seen = (pairs_of(dyads, by) if pairs is None else pairs).where("f is not null and g is not null")
    both = seen.select(*by, F.inline(F.array(F.struct(F.col("f").alias("y"), F.col("g").alias("_b")), F.struct(F.col("g").alias("y"), F.col("f").alias("_b")))))
    return both.groupBy(*by).agg(correlation("y", "_b").alias("dyad_dep"))


def triads(dyads: DataFrame, by: By = ("t",), method: str = "wedges", pairs: DataFrame | None = None, block: int = GRID_BLOCK) -> DataFrame:
    """(by, cycle_dep, trans_dep): normalised third moments of the centred cells around cycles and transitive triples of three actors.

    wedges: pairs point from the end of lower to that of higher degree, so an actor starts at most as many as the
    square root of twice the pairs, however many it has; two pairs from one start are a wedge, and the third
    pair closes it. Each triangle is met once, with its six cells. For networks of which few cells are rows.
    grid: actors in hash blocks, and a task for each three blocks of a network, which multiplies their
    matrices. For full networks; a task holds four blocks of `block` actors squared.
    """
    by = list(by)
    moments = dyads.where("y is not null").groupBy(*by).agg(F.avg("y").alias("mu"), F.stddev_samp("y").alias("sd"))
    if method == "grid":
        sums = _grid_triads(dyads, moments, by, block)
    elif method == "wedges":
        sums = _wedge_triads(pairs_of(dyads, by) if pairs is None else pairs, moments, by)
    else:
        raise ValueError("method is wedges or grid")
    cube = F.pow(F.col("sd"), F.lit(3.0))
    part = lambda name: F.try_divide(F.try_divide(f"{name}_sum", f"{name}_n"), cube).alias(f"{name}_dep")
    return moments.join(sums, by, "left").select(*by, part("cycle"), part("trans"))


def _wedge_triads(pairs: DataFrame, moments: DataFrame, by: list[str]) -> DataFrame:
    ends = pairs.select(*by, F.explode(F.array("lo", "hi")).alias("actor"))
    degree = ends.groupBy(*by, "actor").agg(F.count("*").alias("d"))
    end = lambda name: degree.select(*by, F.col("actor").alias(name), F.col("d").alias(f"d_{name}"))
    known = pairs.join(moments.select(*by, "mu"), by).join(end("lo"), [*by, "lo"]).join(end("hi"), [*by, "hi"])
    keep = (F.col("d_lo") < F.col("d_hi")) | ((F.col("d_lo") == F.col("d_hi")) & (F.col("lo") < F.col("hi")))
    pick = lambda one, two: F.when(keep, F.col(one)).otherwise(F.col(two))
    # e and m are the centred cell and whether there is one, from x to y (1) and back (2)
    cell = lambda v: [F.coalesce(v - F.col("mu"), F.lit(0.0)), v.isNotNull().cast("long")]
    (e1, m1), (e2, m2) = cell(pick("f", "g")), cell(pick("g", "f"))
    point = known.select(*by, pick("lo", "hi").alias("x"), pick("hi", "lo").alias("y"), pick("d_hi", "d_lo").alias("d"), e1.alias("e1"), m1.alias("m1"), e2.alias("e2"), m2.alias("m2"))
    as_ = lambda x, y, k: point.select(*by, F.col("x").alias(x), F.col("y").alias(y), *([F.col("d").alias(f"d_{y}")] if k < 3 else []), *[F.col(c).alias(f"{c}_{k}") for c in ("e1", "m1", "e2", "m2")])
    order = (F.col("d_y") < F.col("d_z")) | ((F.col("d_y") == F.col("d_z")) & (F.col("y") < F.col("z")))
    wedges = as_("x", "y", 1).join(as_("x", "z", 2), [*by, "x"]).where(order).drop("d_y", "d_z")
    closed = wedges.join(as_("y", "z", 3), [*by, "y", "z"])

    def sums(c: str) -> tuple[Column, Column]:
        xy, yx, xz, zx, yz, zy = (F.col(f"{c}{way}_{k}") for k in (1, 2, 3) for way in (1, 2))
        cycles = 3 * (xy * yz * zx + xz * zy * yx)
        # source to middle, middle to sink, source to sink, for each order of the three
        return cycles, xy * yz * xz + xz * zy * xy + yx * xz * yz + yz * zx * yx + zx * xy * zy + zy * yx * zx

    (cycle, trans), (cycles, transitive) = sums("e"), sums("m")
    return closed.groupBy(*by).agg(F.sum(cycle).alias("cycle_sum"), F.sum(cycles).alias("cycle_n"), F.sum(trans).alias("trans_sum"), F.sum(transitive).alias("trans_n"))


def _grid_triads(dyads: DataFrame, moments: DataFrame, by: list[str], block: int) -> DataFrame:
    import pandas as pd

    cells = dyads.where("y is not null and i <> j").join(moments.select(*by, "mu"), by)
    most = cells.groupBy(*by).agg(F.approx_count_distinct("i").alias("n")).agg(F.max("n")).first()[0] or 1
    side = -(-most // block)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    placed = cells.select(*by, "i", "j", (F.col("y") - F.col("mu")).alias("e"), of("i").alias("p"), of("j").alias("q"))
    # the block (p, q) takes part in the three blocks (p, q, c) as ab and, once for each a and b, as bc, cb and ca
    third = F.sequence(F.lit(0), F.lit(side - 1))
    part = lambda role, a, b, c: placed.withColumn("k", F.explode(third)).select(*by, "i", "j", "e", F.lit(role).alias("role"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))
    dealt = part("ab", "p", "q", "k").unionByName(part("bc", "k", "p", "q")).unionByName(part("cb", "k", "q", "p")).unionByName(part("ca", "q", "k", "p"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name in by), "c1 double, c2 long, t1 double, t2 long"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = dict(list(pdf.groupby("role")))
        out = {**{k: [pdf[k].iloc[0]] for k in by}, "c1": [0.0], "c2": [0], "t1": [0.0], "t2": [0]}
        if "ab" not in parts or "ca" not in parts:
            return pd.DataFrame(out)
        numbers = {}
        for name in "abc":
            ends = [parts[r]["i" if r[0] == name else "j"] for r in parts if name in r]
            numbers[name] = {v: k for k, v in enumerate(pd.unique(pd.concat(ends)))}

        def matrix(role: str) -> tuple[np.ndarray, np.ndarray]:
            e, m = np.zeros((2, len(numbers[role[0]]), len(numbers[role[1]])))
            if role in parts:
                at = parts[role]["i"].map(numbers[role[0]]).to_numpy(), parts[role]["j"].map(numbers[role[1]]).to_numpy()
                e[at], m[at] = parts[role]["e"], 1
            return e, m

        ab, bc, cb, ca = (matrix(r) for r in ("ab", "bc", "cb", "ca"))
        for k, (cycle, trans) in enumerate((("c1", "t1"), ("c2", "t2"))):
            out[cycle] = [((ab[k] @ bc[k]) * ca[k].T).sum()]
            out[trans] = [((ab[k] @ cb[k].T) * ca[k].T).sum()]
        return pd.DataFrame(out).astype({"c2": "int64", "t2": "int64"})

    sums = dealt.groupBy(*by, "a", "b", "c").applyInPandas(one, schema)
    return sums.groupBy(*by).agg(F.sum("c1").alias("cycle_sum"), F.sum("c2").alias("cycle_n"), F.sum("t1").alias("trans_sum"), F.sum("t2").alias("trans_n"))


def _numbered(ends: DataFrame) -> DataFrame:
    """ends, written, with a number from 0 without gaps in `id`; only the sizes of the partitions meet in the driver."""
    rows = written(ends.withColumn("at", F.monotonically_increasing_id()), "ends")
    part, row = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    begin, begins = 0, {}
    for p, n in sorted(tuple(r) for r in rows.groupBy(part).count().collect()):
        begins[p], begin = begin, begin + n
    if begin >= 1 << 31:
        raise ValueError("more than 2^31 actors on a side")
    table = ends.sparkSession.createDataFrame(list(begins.items()), "part int, begin long")
    return rows.withColumn("part", part).join(F.broadcast(table), "part").withColumn("id", (F.col("begin") + row).cast("int")).drop("part", "begin", "at")


def _pair_counter() -> Callable:
    """A mapInArrow function to (a, cycles, open) of rows (a, w) in order of a, where w are partners of a: pairs of equal partners, and partners met twice at least.

    Partners of an actor that goes on in the next batch are held once each, with how often they were met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def made(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            actors, begin = np.unique(keys >> 32, return_index=True)
            sums = [np.add.reduceat(x, begin) for x in (n * (n - 1) // 2, (n >= 2).astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(actors.astype(np.int32)), *map(pa.array, sums)], names=["a", "cycles", "open"])

        for batch in batches:
            lists = batch.column(1)
            actors = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()))
            if not len(actors):
                continue
            keys = np.sort(actors << 32 | lists.flatten().to_numpy())
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[begin], np.diff(np.append(begin, len(keys)))
            if len(held):
                same = np.searchsorted(keys, ((held[0] >> 32) + 1) << 32)
                both, where = np.unique(np.concatenate([held, keys[:same]]), return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, where, np.concatenate([times, n[:same]]))
                keys, n = np.concatenate([both, keys[same:]]), np.concatenate([total, n[same:]])
            last = np.searchsorted(keys, keys[-1] >> 32 << 32)
            held, times = keys[last:], n[last:]
            if last:
                yield made(keys[:last], n[:last])
        if len(held):
            yield made(held, times)

    return run


def _shared_partners(ties: DataFrame, ends: DataFrame, by: list[str], size: list[str]) -> DataFrame:
    """(by, cycles, open) over pairs of ends that share centres, for ties (by, v, u, starts) and ends (by, u, *size).

    A centre's ends are in order of size and number. From those that start, a row goes out with the ends before, as arrays of
    numbers of bounded length; rows of an end are sorted together and their partners counted in numpy. What is shuffled is a number for each wedge.
    """
    ids = _numbered(ends)
    place = Window.partitionBy(*by, "v").orderBy(*size, "id")
    ranked = ties.join(ids, [*by, "u"]).select(*by, "v", "id", "starts", (F.row_number().over(place) - 1).alias("at"))
    chunk = F.floor(F.col("at") / CHUNK).cast("int")
    chunks = ranked.groupBy(*by, "v", chunk.alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("w"))
    before = F.least(F.lit(CHUNK), F.col("at") - F.col("chunk") * CHUNK)
    rows = ranked.where("starts and at > 0").select(*by, "v", F.col("id").alias("a"), "at").join(chunks, [*by, "v"]).where(before > 0).select("a", F.slice("w", F.lit(1), before).alias("w"))
    found = rows.repartition("a").sortWithinPartitions("a").mapInArrow(_pair_counter(), "a int, cycles long, open long")
    return found.join(ids.select(*by, F.col("id").alias("a")), "a").groupBy(*by).agg(F.sum("cycles").alias("cycles"), F.sum("open").alias("open"))


def butterflies(dyads: DataFrame, by: By = ("t",)) -> DataFrame:
    """(by, four_cycles): pairs of shared partners over all pairs of one side, which is the same for either side.

    Actors of both sides are ordered by degree. A cycle is counted at its last actor u: wedges u - v - w go
    over a centre v before u to an actor w before u, so a tie makes as many as its end of lower degree has ties.
    A hub whose partners have few ties of their own makes none.
    """
    by = list(by)
    ties = dyads.where("y <> 0").select(*by, F.col("i").alias("r"), F.col("j").alias("c")).distinct()
    size = lambda end: ties.groupBy(*by, end).agg(F.count("*").alias(f"d_{end}")).where(F.col(f"d_{end}") > 1)
    known = written(ties.join(size("r"), [*by, "r"]).join(size("c"), [*by, "c"]), "ties")  # a cycle's actors have two ties at least
    counts = None
    for u, v, after in (("r", "c", F.col("d_r") >= F.col("d_c")), ("c", "r", F.col("d_c") > F.col("d_r"))):
        ends = known.select(*by, F.col(u).alias("u"), F.col(f"d_{u}").alias("d")).distinct()
        made = _shared_partners(known.select(*by, F.col(v).alias("v"), F.col(u).alias("u"), after.alias("starts")), ends, by, ["d"]).select(*by, F.col("cycles").alias("n"))
        counts = made if counts is None else counts.unionByName(made)
    total = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    return dyads.select(*by).distinct().join(total, by, "left").select(*by, F.coalesce("n", F.lit(0).cast("long")).alias("four_cycles"))


def four_cycles(dyads: DataFrame, by: By = ("t",), side: str | None = None) -> DataFrame:
    """(by, four_cycles, clustering): pairs of shared partners over all pairs of one side, and per pair that has two at least.

    The sum over pairs of rows equals that over pairs of columns; without `side` the one is joined that makes fewer
    pairs. Actors of one tie have no part in a pair that counts, so ties of such are left out, twice over: a star has none.
    """
    by = list(by)
    ties = written(dyads.where("y <> 0").select(*by, "i", "j").distinct(), "ties")
    for _ in range(2):
        for c in ("i", "j"):
            ties = ties.join(ties.groupBy(*by, c).count().where("count > 1").select(*by, c), [*by, c], "left_semi")
        ties = written(ties, "ties")  # each step reads the one before twice
    if side is None:
        pairs = lambda c: ties.groupBy(*by, c).count().agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] or 0
        side = "row" if pairs("j") <= pairs("i") else "col"
    one, other = ("i", "j") if side == "row" else ("j", "i")
    placed = ties.select(*by, F.col(other).alias("v"), F.col(one).alias("u"), F.lit(True).alias("starts"))
    made = _shared_partners(placed, placed.select(*by, "u").distinct(), by, [])
    out = dyads.select(*by).distinct().join(made, by, "left")
    cycles = F.coalesce("cycles", F.lit(0).cast("long"))
    return out.select(*by, cycles.alias("four_cycles"), F.when(F.col("open") > 0, cycles / F.col("open")).otherwise(0.0).alias("clustering"))


def unipartite_statistics(dyads: DataFrame, by: By = ("t",), method: str = "wedges") -> DataFrame:
    """The five statistics of a square network: sd_row, sd_col, dyad_dep, cycle_dep, trans_dep; undefined ones are 0."""
    by = list(by)
    pairs = written(pairs_of(dyads, by), "pairs")
    out = heterogeneity(dyads, by).join(reciprocity(dyads, by, pairs), by, "left").join(triads(dyads, by, method, pairs), by, "left")
    names = ["sd_row", "sd_col", "dyad_dep", "cycle_dep", "trans_dep"]
    return out.select(*by, *[F.coalesce(F.nanvl(F.col(n), F.lit(0.0)), F.lit(0.0)).alias(n) for n in names])


def bipartite_statistics(dyads: DataFrame, by: By = ("t",), absent: bool = False) -> DataFrame:
    """sd_row, sd_col and four_cycles of a network of two modes; with `absent`, of edges, whose pairs without a row are zeros."""
    by = list(by)
    return (edge_heterogeneity if absent else heterogeneity)(dyads, by).join(butterflies(dyads, by), by).select(*by, "sd_row", "sd_col", F.col("four_cycles"))


def network_statistics(dyads: DataFrame, square: bool | None = None, by: By = ("t",), custom: dict[str, Column | Callable] | None = None) -> DataFrame:
    """The statistics of the network's mode, which is square if its two sides share an actor, and the user's."""
    if square is None:
        sides = dyads.select(F.col("i").alias("a")).distinct().join(dyads.select(F.col("j").alias("a")).distinct(), "a", "left_semi")
        square = not sides.isEmpty()
    out = unipartite_statistics(dyads, by) if square else bipartite_statistics(dyads, by)
    return out.join(custom_statistics(dyads, custom, by), list(by)) if custom else out


def custom_statistics(dyads: DataFrame, statistics: dict[str, Column | Callable], by: By = ("t",)) -> DataFrame:
    """User statistics: Column aggregates run as such; Python functions run per network, and a failing one gives null."""
    import pandas as pd

    by = list(by)
    columns = {n: s for n, s in statistics.items() if isinstance(s, Column)}
    functions = {n: s for n, s in statistics.items() if not isinstance(s, Column)}
    out = dyads.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()]) if columns else dyads.select(*by).distinct()
    if not functions:
        return out
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dyads.schema if f.name in by), *(f"`{n}` double" for n in functions)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {b: [pdf[b].iloc[0]] for b in by}
        for name, f in functions.items():
            try:
                found[name] = [float(f(pdf[["i", "j", "y"]]))]
            except Exception:  # noqa: BLE001  a user's statistic may fail on a network; null tells where
                found[name] = [np.nan]
        return pd.DataFrame(found)

    made = dyads.select(*by, "i", "j", "y").groupBy(*by).applyInPandas(one, schema)
    return out.join(made.select(*by, *[F.nanvl(F.col(n), F.lit(None).cast("double")).alias(n) for n in functions]), by)


def period_statistic(dyads: DataFrame, name: str, by: By = ("t",)) -> DataFrame:
    """(by, value) of density, mean, reciprocity or transitivity.

    density counts null cells and the diagonal in the denominator; `density_observed` does not.
    """
    by = list(by)
    tie = F.coalesce((F.col("y") != 0).cast("double"), F.lit(0.0))
    if name == "density":
        return dyads.groupBy(*by).agg(F.avg(tie).alias("value"))
    if name == "density_observed":
        return dyads.where("y is not null").groupBy(*by).agg(F.avg(tie).alias("value"))
    if name == "mean":
        return dyads.groupBy(*by).agg(F.avg("y").alias("value"))
    if name == "reciprocity":
        pairs = transposed(dyads, "_b", "y", by).where("i < j and y is not null and _b is not null")
        return pairs.groupBy(*by).agg(correlation("y", "_b").alias("value"))
    if name == "transitivity":
        ties = dyads.where("y <> 0 and i <> j").select(*by, "i", "j").distinct()
        first, second = ties.select(*by, F.col("i").alias("a"), F.col("j").alias("b")), ties.select(*by, F.col("i").alias("b"), F.col("j").alias("c"))
        paths = first.join(second, [*by, "b"]).where("a <> c").groupBy(*by, "a", "c").agg(F.count("*").alias("n"))
        closed = paths.join(ties.select(*by, F.col("i").alias("a"), F.col("j").alias("c"), F.lit(1).alias("closed")), [*by, "a", "c"], "left")
        return closed.groupBy(*by).agg((F.sum(F.when(F.col("closed") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("value"))
    raise ValueError(f"no statistic {name}")


def temporal_trend(observed: DataFrame, replicates: DataFrame, name: str = "density") -> DataFrame:
    """Slope of a per-period statistic on t against that of replicated panels (with a column `rep`): slope, p, n_rep.

    Needs three periods; slopes that do not vary give p = 1.
    """
    slope = F.regr_slope("value", F.col("t").cast("double"))
    seen = period_statistic(observed, name).agg(slope.alias("slope"), F.count("*").alias("n_periods"))
    made = period_statistic(replicates, name, ("rep", "t")).groupBy("rep").agg(slope.alias("s"))
    spread = made.agg(F.stddev_samp("s").alias("sd"), F.count("*").alias("n_rep"))
    both = made.crossJoin(F.broadcast(seen))
    up = both.agg(F.avg((F.col("s") >= F.col("slope")).cast("double")).alias("up"), F.avg((F.col("s") <= F.col("slope")).cast("double")).alias("down"))
    one = seen.crossJoin(spread).crossJoin(up)
    p = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) < 1e-12, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.least("up", "down")))
    return one.select("slope", F.when(F.col("n_periods") >= 3, p).alias("p"), "n_rep", F.col("sd").alias("slope_sd"))
