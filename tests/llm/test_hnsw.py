"""Recall and exact distances against all pairs, and cases with defined results."""

import math

import numpy as np
from pyspark.sql import functions as F

from relata.llm import hnsw as h

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=10):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    for q, v in queries:
        d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
        found = sorted({(a, int(b)) for a, b in zip(d, ids) if b != q})[:k]
        out[q] = found
    return out


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.15, (3000, 16))).astype(np.float32)
    x[500:1500] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in h.nearest(frame, F.col("vec_id") % 50 == 0, shard_bytes=700 * 16 * 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    assert sorted(got) == sorted(want)
    hits = 0
    for q, found in got.items():
        found = [found[k] for k in range(1, 11)]
        assert found == sorted(found)
        for score, i in found:
            assert math.isclose(score, math.dist(x[q].astype(float), x[i].astype(float)), rel_tol=1e-12, abs_tol=1e-12)
        hits += sum(i in {b for _, b in want[q]} for _, i in found)
    assert hits >= 0.97 * 10 * len(want)
    assert [b for _, b in (got[500][k] for k in range(1, 11))] == list(range(501, 511))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 4.0]), (300, None)]
    got = h.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA), F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert found == {0: [(1, 0.0), (2, 1.0), (100, 1.414214)], 100: [(0, 1.414214), (1, 1.414214), (2, 2.236068)], 200: [(9, 1.0)]}
    assert h.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_single_layer_search_is_exhaustive_on_a_small_graph():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 4))
    index = h.build(np.arange(40), x)
    q, ids, d = h.search(index, np.array([1000]), x[:1] + 0.01, 5)
    want = np.argsort(((x - x[0] - 0.01) ** 2).sum(1))[:5]
    assert ids.tolist() == want.tolist() and q.tolist() == [1000] * 5 and (np.diff(d) >= 0).all()


def test_inserted_graph_on_scattered_vectors():
    """Vectors without any clusters are the hard case; a walk finds most of the nearest, and looks at a part of the graph only."""
    x = np.random.default_rng(5).normal(0, 1, (6000, 32))
    index = h.build(np.arange(6000), x)
    asked = np.arange(0, 6000, 60)
    visits = np.zeros(len(asked), int)
    q, ids, _ = h.search(index, asked, x[asked], 10, ef=160, visits=visits)
    hits = 0
    for a in asked:
        near = np.argsort(((x - x[a]) ** 2).sum(1))[1:11]
        hits += len(set(near) & set(ids[q == a]))
    assert hits >= 0.95 * 10 * len(asked) and 0 < visits.mean() < 0.6 * 6000
    n, most = index["sizes"][0]
    links = index["links"][: n * most].reshape(n, most)
    assert n == 6000 and all(len(set(r[r >= 0])) == (r >= 0).sum() and k not in r for k, r in enumerate(links))
    assert [s[0] for s in index["sizes"]] == sorted((s[0] for s in index["sizes"]), reverse=True)


def test_work_in_small_pieces_changes_nothing(monkeypatch):
    x = np.random.default_rng(6).normal(0, 1, (500, 8))
    a = h.build(np.arange(500), x)
    monkeypatch.setattr(h, "WORKED", 4096)
    b = h.build(np.arange(500), x)
    assert a["sizes"].tolist() == b["sizes"].tolist() and (a["links"] == b["links"]).mean() > 0.99
    huge = h.build(np.arange(500), x * 1e100)
    assert h.search(huge, np.array([0]), x[:1] * 1e100, 3)[1].tolist() == h.search(a, np.array([0]), x[:1], 3)[1].tolist()
