"""Decontamination against a brute-force comparison of every window with every position."""

import hashlib
import random
import re

import pytest

from relata.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items):
    w = words(doc)
    hit, found = set(), set()
    for item_id, text in items:
        v = words(text)
        size = min(10, len(v))
        for p in range(len(v) - size + 1 if v else 0):
            for q in range(len(w) - size + 1):
                if w[q : q + size] == v[p : p + size]:
                    hit.update(range(q, q + size))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def corpus(seed, n_docs=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Éa", "ça", "x1", "über", "AND", "to"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.choice([1, 3, 9, 10, 11, 25, 40]))) for i in range(12)] + [(100, None), (101, ""), (102, " .,"), (None, item(12)), (3, item(15))]
    items[0] = (0, "onlyhere")
    docs = []
    for i in range(n_docs):
        parts = [item(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(2), (rng.choice(items)[1] or "").upper())
        docs.append((i, rng.choice([" ", "\n", ", ", "--"]).join(parts)))
    return docs + [(900, None), (901, ""), (902, "..."), (903, "onlyhere"), (3, "onlyhere ONLYHERE"), (904, "x" * 50 + " the")], items


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 20)])
def test_against_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = d.annotate(frame, spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert got == sorted((i, *brute(t, items)) for i, t in docs)


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "a b " + " ".join(f"w{i}" for i in range(5, 22)) + " c"), (2, " ".join(f"w{i}" for i in range(9)))]
    rows = d.annotate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert (rows[0].longest_words, rows[0].longest_at, rows[0].longest_item) == (17, 2, "7")
    assert (rows[1].n_hit, rows[1].longest_words, rows[1].longest_at) == (0, 0, None)


def test_removal_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "n_hit", None), (2, "q r", "x", 3), (2, "q r", "x", 3)], "doc_id long, text string, contaminated string, _decon int")
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2, 2]
    assert d.decontaminate(docs, bench.limit(0)).count() == 3
    assert d.decontaminate(docs.limit(0), bench).count() == 0


def test_words_over_pieces_and_text_edges(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from relata.llm import words as w

    texts = ["ab", "cd ef", "", "é" * 40 + " x", "y" * 90, "z", None, "a b c d e f g h i j k l m n o p q r s t u v w x y z"]
    whole = w.word_hashes(*w.utf8(pa.array(texts)))
    monkeypatch.setattr(w, "PIECE", 16)
    w._powers.cache_clear()
    cut = w.word_hashes(*w.utf8(pa.array(texts)))
    for a, b in zip(whole, cut):
        assert np.array_equal(a, b)
    assert list(np.diff(whole[2])) == [len(words(t)) for t in texts]


def longest_brute(doc, items):
    """(words, place, item) of the longest match of at least a window, at the least place, of the first item that has it."""
    w, best = words(doc), (0, None, None)
    for q in range(len(w)):
        for item_id, text in items:
            v = words(text)
            for p in range(len(v) - min(10, len(v)) + 1 if v else 0):
                n = 0
                while q + n < len(w) and p + n < len(v) and w[q + n] == v[p + n]:
                    n += 1
                if n >= min(10, len(v)) and n > best[0]:
                    best = (n, q, None if item_id is None else str(item_id))
    return best


@pytest.mark.parametrize("seed,held", [(1, 2), (4, 0)])
def test_longest_against_brute_force(spark, seed, held, monkeypatch):
    docs, items = corpus(seed, 40)
    monkeypatch.setattr(d.Needles.__init__, "__defaults__", (held,))
    got = d.annotate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1)).collect()
    want = {(i, t): longest_brute(t, items) for i, t in docs}
    for r in got:
        n, at, item = want[(r.doc_id, r.text)]
        assert (r.longest_words, r.longest_at) == (n, at)
        if n:
            v = words(r.text)[at : at + n]
            assert any(v == words(t)[p : p + n] for i, t in items if r.longest_item in (None, str(i)) for p in range(len(words(t))))


def test_many_equal_windows_make_no_pairs():
    """10,000 items that share a window, in a text that repeats it 10,000 times: work and memory are those of the sum."""
    import tracemalloc

    import pyarrow as pa

    window = "a b c d e f g h i j"
    block = d.NeedleBlock([str(k) for k in range(10_000)], [f"{window} k{k}" for k in range(10_000)], 10)
    tracemalloc.start()
    shard = d.Shard(pa.array([f"{window} " * 10_000, f"x {window} k77 y"]))
    shard.meet(block)
    found = {k: v.to_pylist() for k, v in shard.columns().items()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert found["n_hit"] == [100_000, 11] and found["n_items"] == [10_000, 10_000] and found["longest_words"] == [10, 11]
    assert found["longest_item"] == ["0", "77"] and found["longest_at"] == [0, 1]


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    block = d.NeedleBlock(["1"], ["red green"], 10)
    shard = d.Shard(pa.array(["red green blue", "red grean blue"]))
    words = d.keyed_word_hashes(shard.data, shard.starts, shard.lengths)
    words[4] = words[1]  # as if grean had the hash of green
    shard.hashes[0] = words
    shard.meet(block)
    assert shard.columns()["n_hit"].to_pylist() == [2, 0]
    # another block of the same search may well have that word
    shard.meet(d.NeedleBlock(["2"], ["red grean"], 10))
    assert (words[4], shard.columns()["n_hit"].to_pylist()) == (words[1], [2, 0])
    # words of the test set that clash get another seed, and texts are hashed with it
    plain = d.keyed_word_hashes
    monkeypatch.setattr(d, "keyed_word_hashes", lambda data, starts, lengths, seed=0: plain(data, starts, lengths, seed) if seed else np.ones(len(starts), np.uint64))
    block, shard = d.NeedleBlock(["1"], ["red green"], 10), d.Shard(pa.array(["red green blue", "red grean blue"]))
    shard.meet(block)
    assert block.seed == 1 and shard.columns()["n_hit"].to_pylist() == [2, 0]


def pattern(n):
    """The first letters of the Thue-Morse sequence: with its complement it defeats sums of powers of any base modulo 2^64."""
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_defeat_powers_of_a_base(spark):
    one = pattern(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"{two}"), (3, pattern(1024)), (4, one[:-1])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, f"{one} y"), (8, two), (9, f"x {two}")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in d.annotate(docs, bench).collect()}
    assert got == {1: (2, 1), 2: (1, 1), 3: (0, 0), 4: (0, 0)}


def test_blocks_come_from_tasks_and_find_the_same(spark):
    docs = spark.createDataFrame([(k, f"w{k} alpha beta w{k + 1} gamma") for k in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"w{k} alpha beta") for k in range(0, 60, 2)], "item_id long, text string").repartition(7)
    rows = lambda **o: sorted((r.doc_id, r.n_hit, r.n_items, r.longest_item) for r in d.annotate(docs, bench, **o).collect())
    needles = d.needle_blocks(bench, "item_id", "text", 10, 10)
    assert len(needles.names) >= 10 and len(d.needle_blocks(bench, "item_id", "text", 10, 1 << 20).names) == 1
    assert rows() == rows(block_words=10) and sum(r[1] for r in rows()) == 90


def test_files_of_blocks_follow_the_size_of_the_items(spark):
    import os

    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20 if k % 2 else 4))) for k in range(60)], "item_id long, text string")
    needles = d.needle_blocks(bench, "item_id", "text", 10, 10)
    sizes = [os.path.getsize(f"{needles.folder.removeprefix('file://')}/{name}") for name in needles.names]
    assert len(sizes) >= 10 and sum(sizes) < 1 << 20
    # what a file is without is there again when it is read
    docs = spark.createDataFrame([(k, f"a w{k}x0 w{k}x1 w{k}x2 w{k}x3 " + " ".join(f"w{k}x{j}" for j in range(4, 20))) for k in range(70)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in d.annotate(docs, bench, block_words=10).collect()}
    assert got == {k: (0, 0) if k >= 60 else (20, 1) if k % 2 else (4, 1) for k in range(70)}


def test_a_large_block_in_a_file():
    import pickle

    import numpy as np

    block = d.NeedleBlock([str(k) for k in range(200)], [" ".join(f"w{k}x{j}" for j in range(100)) for k in range(200)], 10)
    data = pickle.dumps(block)
    assert len(data) < 150 * len(block.words)
    again = pickle.loads(data)
    for name in ("low", "high", "sieve", "leads", "words"):
        assert np.array_equal(getattr(again, name), getattr(block, name))


def test_columns_that_would_clash(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, N_HIT int")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    with pytest.raises(ValueError, match="n_hit"):
        d.annotate(docs, bench)
    assert d.annotate(docs, bench, prefix="d_").first().d_n_hit == 1
