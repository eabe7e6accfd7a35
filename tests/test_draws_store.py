"""The packed store: exact round trips, appended and broken runs, fewer rows, and folders that are not opened."""

import numpy as np
from pyspark.sql import functions as F

from relata.sources import draws as s

SCHEMA = "chain int, draw int, block string, term string, t int, i string, j string, value double"


def table(spark, chains=(0, 1), draws=6):
    rng = np.random.default_rng(1)
    rows = []
    for c in chains:
        for k in range(draws):
            rows += [(c, k, "beta", n, None, None, None, float(rng.normal())) for n in ("intercept", "x")]
            rows += [(c, k, "a", "a", t, f"actor{i}", None, float(rng.normal())) for t in (1, 2) for i in range(30)]
            if k % 2:
                rows.append((c, k, "beta", "only odd", 3, "i", "j", 0.5))
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    order = lambda df: sorted(map(str, df.select(*SCHEMA.replace(",", "").split()[::2]).collect()))
    return order(a) == order(b)


def test_round_trip_rows_and_pruning(spark, tmp_path):
    path, long = f"file://{tmp_path}/d", table(spark).repartition(5)
    s.pack(long, path, chunk=16)
    assert same(s.unpack(spark, path), long)
    assert same(s.unpack(spark, path, "a", 1), long.where("block = 'a' and chain = 1"))
    assert same(s.unpack(spark, path, ["beta"]), long.where("block = 'beta'"))
    chunks = s.packed(spark, path).where("block = 'a'").select("chunk").distinct().count()
    assert 2 < chunks <= 4 and s.packed(spark, path).count() * 10 <= long.count()
    plan = s.unpack(spark, path, "a", 1)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "values" in x)
    assert "PartitionFilters" in scan and all(f"{c}#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] for c in ("run", "block", "chain"))


def test_runs_are_appended_and_broken_ones_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    one, two = table(spark, (0,)), table(spark, (1,), 3)
    s.pack(one, path)
    s.pack(two, path)
    assert len(s.runs(spark, path)) == 2 and same(s.unpack(spark, path), one.unionByName(two))
    # a run whose manifest row was never written
    s.packed(spark, path).drop("run").withColumn("draw", F.lit(99)).write.partitionBy("block", "chain").parquet(f"{path}/values/run=broken")
    assert same(s.unpack(spark, path), one.unionByName(two))


def test_defined_cases(spark, tmp_path):
    rows = [(0, 1, "b", "x", None, None, None, 1.0), (0, 1, "b", "x", None, None, None, 3.0), (0, 2, "b", "x", None, None, None, None), (0, 2, "b", "y", 1, None, "j", 2.0)]
    s.pack(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/d")
    got = [(r.draw, r.term, r.value) for r in s.unpack(spark, f"file://{tmp_path}/d").orderBy("draw").collect()]
    assert got == [(1, "x", 3.0), (2, "y", 2.0)]
    s.pack(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")
    assert s.unpack(spark, f"file://{tmp_path}/e").count() == 0
