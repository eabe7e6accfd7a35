"""Triads and four-cycles against whole matrices, on skewed networks and by every method."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.operators import statistics as s
from relata.sources.edges import edges_to_dyads


def dense(y):
    """cycle_dep, trans_dep and dyad_dep of one matrix with nulls; the diagonal takes no part."""
    e = y.copy()
    mu, sd = np.nanmean(y), np.nanstd(y[~np.isnan(y)], ddof=1)
    np.fill_diagonal(e, np.nan)
    m = (~np.isnan(e)).astype(float)
    e = np.nan_to_num(e - mu) * m
    cycle = ((e @ e) * e.T).sum() / ((m @ m) * m.T).sum() / sd**3
    trans = ((e @ e.T) * e.T).sum() / ((m @ m.T) * m.T).sum() / sd**3
    both = (m * m.T) > 0
    return cycle, trans, np.corrcoef(e[both], e.T[both])[0, 1]


def table(spark, panels):
    rows = [(t, f"a{i:02d}", f"a{j:02d}", None if np.isnan(y[i, j]) else float(y[i, j])) for t, y in panels.items() for i in range(len(y)) for j in range(len(y))]
    return spark.createDataFrame(rows, "t int, i string, j string, y double")


@pytest.mark.parametrize("options", [{"method": "wedges"}, {"method": "grid"}, {"method": "grid", "block": 5}])
def test_triads_equal_the_matrix_products(spark, options):
    rng = np.random.default_rng(4)
    panels = {}
    for t, seen in enumerate((1.0, 0.6, 0.15)):
        y = rng.normal(size=(14, 14))
        y[rng.random(y.shape) > seen] = np.nan
        np.fill_diagonal(y, np.nan)
        panels[t] = y
    panels[1][3, :] = rng.normal(size=14)  # one that is tied to all
    panels[1][3, 3] = np.nan
    cells = table(spark, panels)
    got = {r.t: (r.cycle_dep, r.trans_dep) for r in s.triads(cells, **options).collect()}
    back = {r.t: r.dyad_dep for r in s.reciprocity(cells).collect()}
    for t, y in panels.items():
        cycle, trans, dyad = dense(y)
        assert np.allclose(got[t], (cycle, trans)) and np.isclose(back[t], dyad)


def test_networks_without_triangles_and_self_ties(spark):
    rows = [(0, "a", "b", 1.0), (0, "b", "c", 2.0), (1, "a", "a", 5.0), (1, "a", "b", 1.0), (1, "b", "c", 2.0), (1, "c", "a", 4.0)]
    cells = spark.createDataFrame(rows, "t int, i string, j string, y double")
    for method in ("wedges", "grid"):
        got = {r.t: (r.cycle_dep, r.trans_dep) for r in s.triads(cells, method=method).collect()}
        mu, sd = 3.0, np.std([5, 1, 2, 4], ddof=1)
        assert got[0] == (None, None) and np.isclose(got[1][0], (1 - mu) * (2 - mu) * (4 - mu) / sd**3) and got[1][1] is None
    with pytest.raises(ValueError):
        s.triads(cells, method="other")


def plain_cycles(ties):
    rows = {}
    for i, j in ties:
        rows.setdefault(i, set()).add(j)
    names = sorted(rows)
    shared = [len(rows[a] & rows[b]) for k, a in enumerate(names) for b in names[:k]]
    return sum(c * (c - 1) // 2 for c in shared), sum(c >= 2 for c in shared)


def test_four_cycles_of_skewed_networks(spark):
    rng = np.random.default_rng(9)
    for size, p in ((20, 0.3), (30, 0.08)):
        y = rng.random((size, 12)) < p
        y[0] = True
        y[:, 3] = True
        ties = [(f"r{i}", f"c{j}") for i, j in zip(*np.nonzero(y))]
        cells = spark.createDataFrame([(0, i, j, 1.0) for i, j in ties] + [(0, "r0", "zero", 0.0)], "t int, i string, j string, y double")
        cycles, some = plain_cycles(ties)
        assert s.butterflies(cells).first().four_cycles == cycles
        turned = cells.select("t", F.col("j").alias("i"), F.col("i").alias("j"), "y")
        assert s.butterflies(turned).first().four_cycles == cycles
        one = s.four_cycles(cells, side="row").first()
        assert (one.four_cycles, one.clustering) == (cycles, cycles / some)


def test_hubs_make_no_pairs_of_their_leaves(spark):
    """A star of 100,000 leaves has none of its 5 * 10^9 pairs of leaves; two hubs that share them are one pair with many partners."""
    star = spark.range(100_000).select(F.lit(0).alias("t"), F.lit("hub").alias("i"), F.col("id").cast("string").alias("j"), F.lit(1.0).alias("y"))
    assert s.butterflies(star).first().four_cycles == 0
    assert tuple(s.four_cycles(star).first()) == (0, 0, 0.0)
    assert s.triads(star).first().cycle_dep is None
    two = star.unionByName(star.withColumn("i", F.lit("other")))
    assert s.butterflies(two).first().four_cycles == 100_000 * 99_999 // 2
    one = s.four_cycles(two).first()
    assert (one.four_cycles, one.clustering) == (100_000 * 99_999 // 2, 100_000 * 99_999 / 2)
    # ties of the leaves close triangles of the star: a wheel
    rim = star.select("t", F.col("j").alias("i"), F.pmod(F.col("j").cast("long") + 1, F.lit(100_000)).cast("string").alias("j"), "y")
    wheel = star.unionByName(rim).withColumn("y", F.rand(3))
    assert s.triads(wheel).first().trans_dep is not None


def test_edges_of_two_modes_are_not_expanded(spark):
    """Statistics of edges equal those of their spine; 20,000 matched pairs, whose spine has 4 * 10^8 cells, are 20,000 rows."""
    rng = np.random.default_rng(2)
    rows = [(t, f"r{i}", f"c{j}", float(rng.integers(1, 4))) for t in (0, 1) for i in range(9) for j in range(7) if rng.random() < 0.4]
    cells = spark.createDataFrame([*rows, rows[0], (1, "r0", "alone", None)], "t int, i string, j string, y double")
    got = {r.t: r for r in s.bipartite_statistics(cells, absent=True).collect()}
    want = {r.t: r for r in s.bipartite_statistics(edges_to_dyads(cells, square=False)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[t][1:], want[t][1:]) for t in want)
    pairs = spark.range(20_000).select(F.lit(0).alias("t"), F.col("id").cast("string").alias("i"), F.col("id").cast("string").alias("j"), F.lit(1.0).alias("y"))
    assert tuple(s.bipartite_statistics(pairs, absent=True).first()) == (0, 0.0, 0.0, 0)


def test_partners_are_counted_over_arrays_and_batches(spark, monkeypatch):
    """Arrays of three partners and batches of two rows give what whole lists give; only arrays leave the joins, not a row for each wedge."""
    rng = np.random.default_rng(5)
    ties = [(f"r{i}", f"c{j}") for i in range(25) for j in range(15) if rng.random() < 0.5]
    cells = spark.createDataFrame([(t, i, j, 1.0) for t in (0, 1) for i, j in ties[t:]], "t int, i string, j string, y double")
    monkeypatch.setattr(s, "CHUNK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for side in ("row", "col"):
            got = {r.t: r.four_cycles for r in s.four_cycles(cells, side=side).collect()}
            assert got == {t: plain_cycles(ties[t:])[0] for t in (0, 1)}
        assert {r.t: r.four_cycles for r in s.butterflies(cells).collect()} == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
