"""Connected components of a link table by alternating star contraction.

Large-star hangs every greater neighbour of a node onto its least neighbour,
small-star does so with the lesser ones; both only use minima per node and
equi joins, so that a node with very many links costs a split join and not one
task (Kiveris et al., Connected Components in MapReduce and Beyond, 2014). The
links of each round are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.session import written


def star_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of links (a, b) but the roots; root is the least node that can be reached.

    Null ends, loops and repeated links are of no effect; an empty table gives an empty one.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(edges, "links")
        parents = edges.select(F.col("v").alias("u")).distinct()
        open_ends = parents.join(edges.select("u").distinct(), "u", "left_semi").unionByName(edges.groupBy("u").count().where("count > 1").select("u"))
        if open_ends.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components are open after {max_rounds} rounds")
