"""A store of draws with one row for each chain, draw and chunk of a block, and a dictionary of its labels.

A long table of draws repeats the labels of every number. Here a block's labels (term, t, i, j)
are numbered within chunks of bounded size, once, and a draw is an array of values in that
order. Values lie in folders of their run, block and chain, so a reader of one block or chain opens
no other file. A run of writing is read only if the manifest lists it, and its row is written last:
a run that broke off leaves files that nobody reads. Chains are appended as further runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.operators.summaries import let

LABELS = ["term", "t", "i", "j"]
#: Labels of a chunk, about; an array of values is as long.
CHUNK = 10_000


def _chunk(sizes: Column, chunk: int) -> Column:
    return F.pmod(F.xxhash64(*LABELS), F.ceil(sizes / chunk)).cast("int")


def pack(draws: DataFrame, path: str, chunk: int = CHUNK) -> str:
    """Appends draws (chain, draw, block, term, t, i, j, value) to the store at path; the run's name.

    A label that a draw lacks, or that is null there, has a null; of several values of one label in a draw the largest is kept.
    """
    run = uuid.uuid4().hex
    labels = draws.select("block", *LABELS).distinct()
    sizes = labels.groupBy("block").agg(F.count("*").alias("size"))
    order = Window.partitionBy("block", "chunk").orderBy(*LABELS)
    named = labels.join(sizes, "block").withColumn("chunk", _chunk(F.col("size"), chunk)).withColumn("slot", F.row_number().over(order) - 1).select("block", "chunk", "slot", *LABELS)
    named.write.partitionBy("block").parquet(f"{path}/labels/run={run}")
    known = draws.sparkSession.read.schema(named.schema).parquet(f"{path}/labels/run={run}")

    # labels are numbered by their chunk and place, so the long table is joined with the dictionary once
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ["block", *LABELS]]
    placed = draws.alias("d").join(known.alias("l"), same).select("d.block", "d.chain", "l.chunk", "d.draw", "l.slot", F.col("d.value").cast("double").alias("value"))
    length = known.groupBy("block", "chunk").agg(F.count("*").cast("int").alias("length"))
    unit = ["block", "chain", "chunk", "draw"]
    once = placed.repartition(*unit).groupBy(*unit, "slot").agg(F.max("value").alias("value"))  # both groupings stand on this dealing
    rows = once.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("v")).join(length, ["block", "chunk"])
    looked_up = let(F.map_from_entries("v"), lambda m: F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.try_element_at(m, k)))
    values = F.when(F.size("v") == F.col("length"), F.transform("v", lambda x: x["value"])).otherwise(looked_up)
    rows.select("block", "chain", "chunk", "draw", values.alias("values")).write.partitionBy("block", "chain").parquet(f"{path}/values/run={run}")
    counted = draws.sparkSession.read.schema("draw int").parquet(f"{path}/values/run={run}").agg(F.lit(run).alias("run"), F.count("*").alias("rows"))
    counted.write.mode("append").parquet(f"{path}/manifest")
    return run


def runs(spark: SparkSession, path: str) -> list[str]:
    """The runs that were written to their end; a run is one append, so they are few."""
    return sorted(r["run"] for r in spark.read.parquet(f"{path}/manifest").select("run").collect())


def packed(spark: SparkSession, path: str) -> DataFrame:
    """(run, block, chain, chunk, draw, values): the stored rows of the runs in the manifest."""
    whole = spark.read.schema("chunk int, draw int, values array<double>, run string, block string, chain int").parquet(f"{path}/values")
    return whole.where(F.col("run").isin(runs(spark, path))).select("run", "block", "chain", "chunk", "draw", "values")


def unpack(spark: SparkSession, path: str, block: str | list[str] | None = None, chain: int | None = None) -> DataFrame:
    """The long table of draws again, of some blocks or one chain if they are named; labels that a draw lacked are left out."""
    rows = packed(spark, path)
    labels = spark.read.schema("chunk int, slot int, term string, t int, i string, j string, run string, block string").parquet(f"{path}/labels")
    if block is not None:
        wanted = [block] if isinstance(block, str) else list(block)
        rows, labels = rows.where(F.col("block").isin(wanted)), labels.where(F.col("block").isin(wanted))
    if chain is not None:
        rows = rows.where(F.col("chain") == chain)
    long = rows.select("run", "block", "chain", "chunk", "draw", F.posexplode("values").alias("slot", "value")).where("value is not null")
    return long.join(labels, ["run", "block", "chunk", "slot"]).select("chain", "draw", "block", *LABELS, "value")
