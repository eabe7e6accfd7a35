"""Targets, quotas and draws against plain computations."""

import random

import pytest

from relata.llm import source_mixing as m


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Sources in code-point order, null last; share by weight, cut off at most times the size, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        target |= {s: float(most * sizes[s]) for s in over}


def plain_quotas(votes, seats):
    quotients = sorted(((-v / (2 * k - 1), key, k) for key, v in votes.items() if v > 0 for k in range(1, seats + 1)))[:seats]
    return {key: sum(q[1] == key for q in quotients) for key in votes}


@pytest.mark.parametrize("seed", range(4))
def test_quotas_are_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {g: ({k: float(rng.choice([0, 1, 5, 5, 1000 * rng.random(), 7.5])) for k in range(rng.randrange(1, 30))}, rng.choice([0, 1, 3, 17, 200])) for g in range(6)}
    groups[6] = ({0: 0.0, 1: 0.0}, 5)
    rows = [(g, k, v, s) for g, (votes, s) in groups.items() for k, v in votes.items()]
    got = m.sainte_lague(spark.createDataFrame(rows, "g int, k int, v double, s long"), ["g"], ["k"], "v", "s", "quota").collect()
    assert {(r.g, r.k): r.quota for r in got} == {(g, k): q for g, (votes, s) in groups.items() for k, q in plain_quotas(votes, s).items()}


def corpus(seed):
    rng = random.Random(seed)
    docs = []
    for i in range(900):
        source = rng.choice(["a"] * 10 + ["b", "B", "é", None, "tiny"] if i % 40 else ["tiny"])
        docs.append((i, " ".join(["w"] * rng.randrange(0, 12 if source == "tiny" else 90)), source))
    return docs + [(5, "x y", "a"), (None, "\t\n x", "b"), (1000, None, "a"), (1001, "", "none at all"), (1002, "one", "once")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    sized = frame.select("doc_id", "source", m.word_count(frame["text"]).alias("size"))
    rows = m.mix(sized, shard_rows=50).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").split()) for _, t, _ in docs)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(r.source_size == sizes[r.source] for r in rows)
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - want[s]) <= 3 + 0.05 * want[s], (s, taken[s], want[s])
    again = m.mix(sized.repartition(7), shard_rows=50).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_empty_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, "s", 4, "x", 1), (1, "s", 4, "x", 2)], "doc_id long, source string, size long, target string, row int")
    got = m.mix(frame, names=("s1", "t1", "k1"))
    assert got.columns == ["doc_id", "source", "size", "target", "row", "s1", "t1", "k1"] and {r.t1 for r in got.collect()} == {8.0}
    assert m.mix(frame.limit(0), names=("s1", "t1", "k1")).count() == 0
    zero = spark.createDataFrame([(1, "s", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [(r.target, r.taken) for r in m.mix(zero).collect()] == [(0.0, 0), (0.0, 0)]


def test_word_counts(spark):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", " a  b\n", "a\u00a0b c", "x\u2003y", "é" * 5 + "\x1f z", "w " * 100_000, "q" * 300_000]
    want = [len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]) for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert [r.n for r in frame.orderBy("k").select(m.word_count(frame["text"]).alias("n")).collect()] == want
