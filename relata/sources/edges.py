"""From edge lists, matrices and graph objects to dyad tables, and back.

A dyad table has columns t, i, j, y and any covariates. On its spine every
ordered pair of the period's actors is a row; y is null where it is not
observed, and on the diagonal of a square network.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DYADS = "t int, i string, j string, y double"


def spine(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """All pairs (t, i, j) of row actors (t, actor) and column actors (t, actor) of the same period."""
    return rows.select("t", F.col("actor").alias("i")).join(columns.select("t", F.col("actor").alias("j")), "t")


def actors_of(edges: DataFrame, by_period: bool = True, square: bool = True) -> tuple[DataFrame, DataFrame]:
    """(t, actor) of the two sides; the same union of senders and receivers if square. Without by_period, every actor is in all periods."""
    rows, columns = edges.select("t", F.col("i").alias("actor")).distinct(), edges.select("t", F.col("j").alias("actor")).distinct()
    if square:
        rows = columns = rows.union(columns).distinct()
    if not by_period:
        periods = edges.select("t").distinct()  # a row per period: broadcast, as every actor meets all of them
        rows, columns = (F.broadcast(periods).crossJoin(x.select("actor").distinct()) for x in (rows, columns))
    return rows, columns


def deduplicate(edges: DataFrame, how: str = "max", order: str | None = None, key: Sequence[str] = ("t", "i", "j"), value: str = "y") -> DataFrame:
    """One row per pair: the largest value, the sum, or the last by an ordering column."""
    if how == "sum":
        return edges.groupBy(*key).agg(F.sum(value).alias(value))
    if how == "max":
        return edges.groupBy(*key).agg(F.max(value).alias(value))
    if how != "last":
        raise ValueError("how is max, sum or last")
    if order is None:
        raise ValueError("last needs an ordering column")
    return edges.groupBy(*key).agg(F.max_by(value, F.struct(order, value)).alias(value))


def edges_to_dyads(edges: DataFrame, directed: bool = True, square: bool = True, dedupe: str = "max", order: str | None = None, actors: DataFrame | None = None) -> DataFrame:
    """Edges (t, i, j[, y]) on the full spine: no edge is 0, the diagonal is null if no self-loop occurs.

    Undirected: the value of a pair is the sum of both directions, so a pair that is listed both ways doubles.
    """
    if "y" not in edges.columns:
        edges = edges.withColumn("y", F.lit(1.0))
    one = deduplicate(edges, dedupe, order)
    if actors is not None:
        rows = columns = actors
    else:
        rows, columns = actors_of(edges, by_period=False, square=square)
    if not directed:
        back = one.select("t", F.col("j").alias("i"), F.col("i").alias("j"), "y")
        one = one.unionByName(back).groupBy("t", "i", "j").agg(F.sum("y").alias("y"))
    full = spine(rows, columns).join(one, ["t", "i", "j"], "left").withColumn("y", F.coalesce(F.col("y").cast("double"), F.lit(0.0)))
    if not square:
        return full.select("t", "i", "j", "y")
    loops = edges.groupBy().agg(F.coalesce(F.max((F.col("i") == F.col("j")).cast("int")), F.lit(0)).alias("loops"))
    return full.crossJoin(F.broadcast(loops)).select("t", "i", "j", F.when((F.col("i") == F.col("j")) & (F.col("loops") == 0), None).otherwise(F.col("y")).alias("y"))


def dyads_to_edges(dyads: DataFrame, directed: bool = True, keep_constant_weight: bool = False) -> DataFrame:
    """Non-zero observed pairs, ordered; undirected keeps i <= j. The weight is kept only if it varies (or there is a single edge)."""
    edges = dyads.where("y <> 0")
    if not directed:
        edges = edges.where("i <= j")
    spread = edges.agg(F.var_samp("y").alias("v"), F.count("*").alias("n")).first()
    varies = keep_constant_weight or spread["n"] == 1 or bool(spread["v"] and spread["v"] > 0)
    return edges.select("t", "i", "j", *(["y"] if varies else [])).orderBy("t", "i", "j")


def align_panel(dyads: DataFrame, square: bool = True, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Ragged periods on the union of all actors: pairs outside a period's presence are null, and `present` tells them from unobserved ones.

    Presence (t, actor) is by default everyone who occurs in the period.
    """
    here_rows, here_columns = (rows, columns) if rows is not None else actors_of(dyads, square=square)
    here_columns = here_columns if here_columns is not None else here_rows
    periods = here_rows.select("t").union(here_columns.select("t")).distinct()
    everyone = lambda x: F.broadcast(periods).crossJoin(x.select("actor").distinct())
    full = spine(everyone(here_rows), everyone(here_columns))
    marked = full.join(here_rows.select("t", F.col("actor").alias("i"), F.lit(1).alias("pi")), ["t", "i"], "left").join(here_columns.select("t", F.col("actor").alias("j"), F.lit(1).alias("pj")), ["t", "j"], "left")
    values = [c for c in dyads.columns if c not in ("t", "i", "j")]
    out = marked.join(dyads, ["t", "i", "j"], "left").withColumn("present", (F.col("pi").isNotNull() & F.col("pj").isNotNull()))
    clean = [F.when(F.col("present") & ((F.col("i") != F.col("j")) | F.lit(not square)), F.col(c)).alias(c) for c in values]
    return out.select("t", "i", "j", *clean, "present")


def restrict_to_presence(dyads: DataFrame, rows: DataFrame, columns: DataFrame | None = None, square: bool = True) -> DataFrame:
    """Pairs whose actors are both present in the period, with a null diagonal if square."""
    columns = rows if columns is None else columns
    kept = dyads.join(rows.select("t", F.col("actor").alias("i")), ["t", "i"], "left_semi").join(columns.select("t", F.col("actor").alias("j")), ["t", "j"], "left_semi")
    return kept.withColumn("y", F.when(F.col("i") == F.col("j"), None).otherwise(F.col("y"))) if square else kept


def long_covariates(dyads: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(t, i, j, name, value) of the covariate columns."""
    names = list(names or [c for c in dyads.columns if c not in ("t", "i", "j", "y", "present")])
    return dyads.unpivot(["t", "i", "j"], names, "name", "value")


def from_matrices(spark: SparkSession, periods: Mapping[int, object] | Sequence[object], rows: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Dyads of one matrix per period; names come from a pandas frame or from the arguments, else they are numbers from 1."""
    import numpy as np
    import pandas as pd

    out = []
    items = periods.items() if isinstance(periods, Mapping) else enumerate(periods, 1)
    for t, m in items:
        frame = m if isinstance(m, pd.DataFrame) else pd.DataFrame(np.asarray(m, float))
        if not all(np.issubdtype(k, np.number) or k == bool for k in frame.dtypes):
            raise TypeError("a network matrix is numeric or logical")
        ri = list(map(str, frame.index)) if isinstance(m, pd.DataFrame) else list(rows or map(str, range(1, frame.shape[0] + 1)))
        ci = list(map(str, frame.columns)) if isinstance(m, pd.DataFrame) else list(columns or map(str, range(1, frame.shape[1] + 1)))
        values = frame.to_numpy(float)
        square = ri == ci
        out += [(int(t), a, b, None if np.isnan(values[r, c]) or (square and r == c) else float(values[r, c])) for r, a in enumerate(ri) for c, b in enumerate(ci)]
    return spark.createDataFrame(out, DYADS)


def as_dyads(spark: SparkSession, graph: object, directed: bool = True, weight: str | None = None) -> DataFrame:
    """A dyad table from a DataFrame of edges, a matrix, a pandas edge list, or any object with nodes() and edges()."""
    import pandas as pd

    if isinstance(graph, DataFrame):
        kinds = dict(graph.dtypes)
        if "y" in kinds and kinds["y"] not in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean"):
            raise TypeError("y is numeric or logical")
        frame = graph if "t" in graph.columns else graph.withColumn("t", F.lit(1))
        return frame.select("t", F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), *[F.col(c).cast("double") if c == "y" else F.col(c) for c in frame.columns if c not in ("t", "i", "j")])
    if hasattr(graph, "nodes") and hasattr(graph, "edges"):
        edges = [(1, str(a), str(b), float((d or {}).get(weight, 1.0)) if weight else 1.0) for a, b, d in graph.edges(data=True)]
        actors = spark.createDataFrame([(1, str(n)) for n in graph.nodes()], "t int, actor string")
        return edges_to_dyads(spark.createDataFrame(edges, DYADS), directed, actors=actors)
    if isinstance(graph, pd.DataFrame) and {"i", "j"} <= set(graph.columns):
        frame = graph.assign(t=graph.get("t", 1), y=graph.get("y", 1.0)).astype({"i": str, "j": str, "y": float})
        return edges_to_dyads(spark.createDataFrame(frame[["t", "i", "j", "y"]], DYADS), directed)
    return from_matrices(spark, [graph])


class FormatError(ValueError):
    """A table does not have the format that a model asks for; `problems` lists all of it."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def check_format(dyads: DataFrame, nodes: DataFrame | None = None, square: bool = True) -> None:
    """Raises FormatError for wrong types, repeated pairs, missing names, covariates that are not numeric, or nodes that are no actors."""
    problems, kinds = [], {f.name: f.dataType for f in dyads.schema}
    missing = {"t", "i", "j", "y"} - set(kinds)
    if missing:
        raise FormatError([f"columns are missing: {', '.join(sorted(missing))}"])
    problems += [f"column {n} is not numeric" for n, k in kinds.items() if n not in ("t", "i", "j") and not isinstance(k, (T.NumericType, T.BooleanType))]
    if not dyads.where("i is null or j is null or i = '' or j = ''").isEmpty():
        problems.append("an actor has no name")
    if not dyads.groupBy("t", "i", "j").count().where("count > 1").isEmpty():
        problems.append("a pair occurs more than once in a period")
    if nodes is not None:
        if not nodes.groupBy(*[c for c in ("t", "actor", "side") if c in nodes.columns]).count().where("count > 1").isEmpty():
            problems.append("a node occurs more than once")
        known = dyads.select(F.col("i").alias("actor")).union(dyads.select(F.col("j").alias("actor"))).distinct()
        if not nodes.join(known, "actor", "left_anti").isEmpty():
            problems.append("a node is no actor of the network")
    if problems:
        raise FormatError(problems)
