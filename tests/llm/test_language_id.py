"""Language identification: cases with defined results, whole texts, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from relata.llm import language_id as l

WORDS = {"en": "the of and that with this hing tion er", "de": "der die und ein sch lich keit ung für", "fr": "le la des que eau oux être çon ment"}


def corpus(n=90):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(8, 40))), lang))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    docs = spark.createDataFrame(corpus() + [(None, "der die und", "de"), (500, "der und", None)], "doc_id long, text string, lang string")
    known = l.learn(docs, F.col("doc_id") % 3 != 0)
    assert sorted(known) == ["de", "en", "fr"]
    cases = [(1, None), (2, ""), (3, "12 34 ..."), (4, "DER  DIE\n\nUND ein"), (4, "der die und ein"), (5, "the that with " * 90_000), (6, "漢字 かな")]
    extra = spark.createDataFrame([(i, t, "x", 1) for i, t in cases], "doc_id long, text string, lang_pred_x string, extra int")
    rows = l.predict(extra, known).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and [r.score for r in rows[:3]] == [0.0] * 3
    assert [r.lang_pred for r in rows[3:6]] == ["de", "de", "en"] and rows[3].score == rows[4].score
    assert rows[6].lang_pred in known and all(0 <= r.score <= 1 for r in rows)
    got = l.predict(docs.where("doc_id % 3 = 0").select("doc_id", "lang", "text"), known).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert l.learn(docs, F.lit(True)) == {}
    assert [r.lang_pred for r in l.predict(docs.select("doc_id", "text"), {}).collect()] == ["und"]
    assert l.predict(docs.limit(0), {"en": np.ones(l.DIMENSIONS)}).count() == 0


def test_the_fitted_sample_is_bounded(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string, lang string")
    known = l.learn(docs, F.lit(True), per_language=10)
    assert sorted(known) == ["de", "en", "fr"]


def test_bundle_is_the_sum_over_trigrams(monkeypatch):
    known = l.alphabet(l.DIMENSIONS, l.SEED)
    text = "Éa b1c--dé " * 7
    symbols = [" "] + list("".join(c.lower() if c.isalpha() else " " for c in text)) + [" "]
    symbols = [s for i, s in enumerate(symbols) if s != " " or i == 0 or symbols[i - 1] != " "]
    at = lambda s: 0 if s == " " else ord(s)
    total = np.zeros(l.DIMENSIONS)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        rows = known.rows(np.array([at(a), at(b), at(c)], np.uint32))
        base = [known.places[2][r].astype(int) for r in rows]
        total += np.roll(base[0], 2) * np.roll(base[1], 1) * base[2]
    assert np.array_equal(l.bundle(text, known), total)
    monkeypatch.setattr(l, "PIECE", 5)
    assert np.array_equal(l.bundle(text, known), total)


def test_letters_of_every_plane():
    """The alphabet has each letter that Python has, up to the last of CJK Extension H."""
    assert [k for k in range(0x110000) if chr(k).isalpha() != bool(l.letters()[k])] == []
    known = l.alphabet(l.DIMENSIONS, l.SEED)
    assert l.bundle("\U000323af\U00032000", known) is not None and l.bundle("12", known) is None
