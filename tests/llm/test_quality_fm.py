"""The factorisation machine: the identity, held-out accuracy, and defined cases."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from relata.llm import quality_fm as q


def corpus(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words) if good else " | ".join(w + "***" for w in words), len(words)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_defined_cases(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    marks = spark.createDataFrame(labels + [(0, 1), (1, 1 - labels[1][1]), (None, 1), (2, None), (99_999, 1)], "doc_id long, quality int")
    machine = q.fit(docs, marks, F.col("k") % 4 != 0)
    got = {r.doc_id: r.score for r in q.score(docs, machine).collect()}
    held = [(got[i], y) for i, y in labels if i % 4 == 0]
    assert sum((s >= q.THRESHOLD) == (y == 1) for s, y in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, None, "a"), (2, "", 0, "b"), (2, "alpha " * 200_000, 5, "c"), (None, "漢", None, "d")], "doc_id long, text string, n_chars long, score string")
    scored = q.score(odd, machine, "score_")
    assert scored.columns == ["doc_id", "n_chars", "score", "score_"] and all(0 <= r.score_ <= 1 for r in scored.collect())
    kept = q.keep_good(odd, machine, 0.0)
    assert kept.columns == odd.columns and kept.count() == 4 and q.keep_good(odd.limit(0), machine).count() == 0
    clash = odd.withColumn("_meta0", F.lit(1)).withColumn("_scored_text", F.lit("x")).withColumn("m0", F.lit(2))
    assert q.keep_good(clash, machine, 0.0).columns == clash.columns and q.keep_good(clash, machine, 0.0).count() == 4
    assert {r.score for r in q.score(docs.drop("n_chars"), machine).collect()} and q.score(docs.limit(0), machine).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, n_chars long")
    machine = q.fit(docs, spark.createDataFrame([(1, None)], "doc_id long, quality int"), F.lit(True))
    assert machine is None and [r.score for r in q.score(docs, machine).collect()] == [0.5]


def test_linear_time_identity_and_slices():
    texts = pa.array(["a b b c", "", "d e f a a", None, "x"])
    text, feature, weight, values = q.extract(texts)
    rng = np.random.default_rng(1)
    machine = q.train([(feature[text == k], weight[text == k]) for k in range(5)], values, np.array([1, 0, 1, 0, 1.0]), steps=20)
    machine.w = rng.normal(0, 1, machine.w.shape).astype(np.float32)
    t, f, x = machine.rows(5, text, feature, weight, values)
    raw, _ = machine.raw(5, t, f, x)
    for k in range(5):
        ids, xs = f[t == k], x[t == k].astype(float)
        pairs = sum(float(machine.v[a].astype(float) @ machine.v[b]) * xs[i] * xs[j] for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j)
        assert abs(raw[k] - (machine.bias + float(machine.w[ids].astype(float) @ xs) + pairs)) < 1e-3
    one = q.extract(texts.slice(2, 1))
    assert np.array_equal(np.sort(one[1]), np.sort(feature[text == 2])) and np.allclose(one[3][0], values[2])
