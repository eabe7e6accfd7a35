"""SimHash links against all pairs, fingerprints against a plain computation."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from relata.llm import simhash_dedup as s
from relata.operators.components import star_components


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = Counter(k for x in shingles for k in range(64) if xxhash.xxh64_intdigest(x.encode(), 42) >> k & 1)
    return sum(1 << k for k, c in counts.items() if 2 * c > len(shingles))


def components(marks):
    parent = {m: m for m in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    marks = sorted(parent)
    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {m: find(m) for m in marks}


def texts(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("ab cd Éf GH ij kl m no".split(" ")) for _ in range(rng.randrange(0, 40))) for _ in range(12)]
    docs = []
    for i in range(60):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["x", "Y", "zz"]))
        docs.append((i, rng.choice([" ", "\n", "\x0b"]).join(words)))
    return docs + [(70, None), (71, ""), (72, " \t"), (73, "one"), (74, "ONE"), (75, "one two"), (5, docs[5][1]), (76, "lorem " * 3000)]


def test_fingerprints_are_as_defined():
    for _, t in texts(3):
        assert s.fingerprint((t or "").encode()) == plain(t)
    long = " ".join(str(i) for i in range(700))
    assert s.fingerprint(long.encode(), at_once=100) == plain(long)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    docs = texts(seed)
    got = s.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    root = components({plain(t) for _, t in docs})
    least = {}
    for i, t in docs:
        least[root[plain(t)]] = min(i, least.get(root[plain(t)], i))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{plain(t):016x}", least[root[plain(t)]]) for i, t in docs)


def test_balls_meet_all_links():
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(8)]
    marks = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for c in centres for _ in range(60)} | {0, (1 << 64) - 1, 7, 1 << 63}
    marks |= {0xFFFF ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    a = np.array(sorted(marks), np.uint64)
    even = np.bitwise_count(a) % 2 == 0
    points = np.concatenate([(a[:, None] ^ s.MASKS[: s.NEAR]).ravel(), (a[even][:, None] ^ s.MASKS[s.NEAR :]).ravel()])
    steps = np.concatenate([np.tile(np.arange(s.NEAR), len(a)), np.tile(np.arange(s.NEAR, len(s.MASKS)), even.sum())])
    x, y = s.forest(*s.meet(points, steps))
    assert all(bin(int(p) ^ int(q)).count("1") for p, q in zip(x, y))
    want = components([int(m) for m in a])
    got = {int(m): int(m) for m in a} | {int(q): int(p) for p, q in zip(x, y)}
    assert got == want


def test_components_by_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(159, 200), (7, 7), (None, 3), (300, 299), (299, 300)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in [*range(101, 160), 200]} | {300: 299}
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    t = "some words that are the same in all of these rows here"
    docs = spark.createDataFrame([(3, t, "a"), (2, t, "b"), (2, t, "b"), (2, t.upper(), "c"), (9, "other words entirely and nothing else", "d"), (None, t, "e")], "doc_id long, text string, mark string")
    got = sorted((r.doc_id or -1, r.mark) for r in s.deduplicate(docs).collect())
    assert [g[0] for g in got] == [-1, 2, 9]
    assert s.deduplicate(docs).columns == docs.columns and s.deduplicate(docs.limit(0)).count() == 0
