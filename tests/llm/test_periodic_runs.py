"""Periodic runs: brute force over all periods, the whole query, and cases with defined results."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np

from relata.llm import periodic_runs as r

SF = "/root/testdata/sf0.001"


def brute(words, min_length=24, min_periods=3):
    """Maximal stretches for each period from the least on; one that an earlier period has too is not its own."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_periods * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j
    return sorted(out)


def runs_of(texts, **options):
    number = {}
    w = np.array([number.setdefault(x, len(number)) for t in texts for x in t], np.int32)
    return r.runs_in(w, np.cumsum([0] + [len(t) for t in texts]), **options)


def test_random_texts_of_few_words_equal_brute_force():
    rng = random.Random(11)
    texts = []
    for _ in range(400):
        words = []
        while len(words) < rng.randrange(160):
            phrase = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
            words += phrase * rng.choice([1, 1, 2, 4, 9]) + phrase[: rng.randrange(len(phrase))]
        texts.append(words)
    assert runs_of(texts) == [brute(t) for t in texts]
    assert runs_of(texts, min_length=6) == [brute(t, 6) for t in texts]
    assert runs_of(texts, min_length=12, min_periods=4) == [brute(t, 12, 4) for t in texts]


def test_blocks_of_any_size_find_the_same(monkeypatch):
    rng = random.Random(2)
    texts = [[rng.choice("ab") for _ in range(n)] + list("abcde") * k for n, k in [(300, 9), (0, 0), (24, 0), (90, 30), (1, 7)]]
    texts.append(["x"] * 500 + ["y"] + ["x"] * 500)
    want = [brute(t) for t in texts]
    for points in (1, 50, 4096):
        monkeypatch.setattr(r, "POINTS", points)
        assert runs_of(texts) == want


def test_extension_is_linear_for_one_word(monkeypatch):
    """A text of one word only is extended once, not once for each period; nor is a nested repetition."""
    calls = []
    plain = r.matched
    monkeypatch.setattr(r, "matched", lambda *a: calls.append(a) or plain(*a))
    assert runs_of([["x"] * 30_000]) == [[(0, 30_000, 1)]] and len(calls) == 1
    calls.clear()
    assert runs_of([list("abcdefg") * 3000]) == [[(0, 21_000, 7)]] and len(calls) == 1


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def test_query_equals_brute_force(spark):
    got = r.op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    order = lambda x: (str(x[0]), x[-1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted((plain(*d) for d in docs), key=order)


def test_defined_cases(spark):
    long = "one two three " * 200_000 + "end"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 24), (4, "a " * 24), (5, "a " * 23), (None, "ä b " * 30), (7, long)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    found, name = r.find(docs)
    assert found.columns == ["doc_id", "found", "found_"] and name == "found_"
    got = {(x.doc_id, k): x.found_ for k, x in enumerate(found.collect())}
    runs = [[tuple(y) for y in v.runs] for v in got.values()]
    assert runs == [[], [], [], [(0, 24, 1)], [(0, 24, 1)], [], [(0, 30, 1)], [(0, 600_000, 3)]]
    texts = [v.collapsed for v in got.values()]
    assert texts == ["", "", "", "a", "a", " ".join("a" * 23), "ä b", "one two three end"]
    assert r.find(docs.limit(0))[0].count() == 0


def test_strongest_is_exact_and_takes_the_first_of_equals(spark):
    rows = [([(5, 24, 8), (0, 30, 10), (9, 24, 8)],), ([(0, 30_000_001, 10_000_000), (1, 3_000_000_001, 1_000_000_000)],), ([],)]
    df = spark.createDataFrame([([dict(zip(("start", "length", "period"), t)) for t in sorted(x[0])],) for x in rows], f"runs {r.RUNS}")
    got = [x.best and tuple(x.best) for x in df.select(r.strongest(df.runs).alias("best")).collect()]
    assert got == [(0, 30, 10), (0, 30_000_001, 10_000_000), None]
