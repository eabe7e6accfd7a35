"""Piece encoding: the library's ids, spans, normalised texts and decoded texts, and cases with defined results."""

import hashlib
import random

import numpy as np
import pytest

from relata.llm import piece_encoding as q

sp = pytest.importorskip("sentencepiece")
SF = "/root/testdata/sf0.001"
PARTS = [" ", "  ", "a", "the", "▁", "é", "é", "漢", "\U0001f600", "\n", "\r\n", "\t", "\x00", "Ａ", "</s>", "<s>", "<0x0A>", "<unk>", "ﷺ", "　", "​", "﻿", "¨", "ｶﾞ", "."]


def mixed(n, seed=5):
    rng = random.Random(seed)
    return ["", " ", "▁", "  a  b "] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return q.model_bytes()


def field(number, value):
    """A length-delimited field of a protobuf message."""
    size, head = len(value), b""
    while size > 127:
        head += bytes([size & 127 | 128])
        size >>= 7
    return bytes([number << 3 | 2]) + head + bytes([size]) + value


def spec_of(rule):
    return dict(q.message(dict(q.message(sp.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[q.NORMALIZER]))


def points(text, normal, align):
    """The record in code points, as the library gives it."""
    before = np.concatenate([[0], np.cumsum([(x & 0xC0) != 0x80 for x in text.encode()])]).astype(int)
    starts = [i for i, x in enumerate(normal) if (x & 0xC0) != 0x80] + [len(normal)]
    return [int(before[align[i]]) for i in starts]


def test_ids_and_spans_are_the_librarys(model):
    texts, own, lib = mixed(1500), q.Pieces(model), sp.SentencePieceProcessor(model_proto=model)
    for text, (ids, begins, ends) in zip(texts, own.encode(texts, False)):
        want = [(x.id, x.begin, x.end) for x in lib.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == want, text
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())) == raw


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_maps(rule, model):
    """Every key of a compiled map is read, and texts are normalised as the library does, with the source of each character."""
    table = q.character_map(spec_of(rule)[q.CHARSMAP])
    assert len(table) > 200_000 and table["Ａ"] == (b"A" if rule == "nmt_nfkc" else b"a")
    for prefix, extra, escape in [(True, True, True), (False, True, True), (True, False, True), (False, False, False), (True, True, False)]:
        lib = sp.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=extra, escape_whitespaces=escape)
        own = q.Normaliser(table, (), prefix, extra, escape)
        for text in mixed(400):
            normal, align = own(text)
            want, places = lib.normalize(text, with_offsets=True)
            assert normal.decode() == want
            assert not want or points(text, normal, align) == list(places), text
    # The same pieces with a map: ids and spans as the library gives them for the whole model.
    own_spec = field(q.NORMALIZER, field(q.CHARSMAP, spec_of(rule)[q.CHARSMAP]) + bytes([q.EXTRA_SPACES << 3, 1]))
    other = q.Pieces(model + own_spec)
    for text, (ids, begins, ends) in zip(mixed(400), other.encode(mixed(400), False)):
        want = [(x.id, x.begin, x.end) for x in other.whole.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == want, text


def test_symbols_of_the_user_go_before_the_map():
    own = q.Normaliser({"a": b"x", "ab": b"yy", "abc": b""}, ("aba",), False, False, True)
    assert own("aab abca")[0] == "xyy▁x".encode() and own("abab")[0] == b"abab"
    normal, align = own("é abab")
    assert normal == "é▁abab".encode() and align.tolist() == [0, 0, 2, 2, 2, 3, 3, 3, 6, 7]


def test_query_equals_the_library(spark, model):
    lib = sp.SentencePieceProcessor(model_proto=model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = lib.encode(d.text or "", add_eos=True)
        want.append((d.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    got = q.op13_piece_encoding(spark, SF)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)


def test_defined_cases(spark, model):
    lib = sp.SentencePieceProcessor(model_proto=model)
    texts = [None, "", "  two  spaces ", "  two  spaces ", "ab\x00漢", "word " * 300_000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, encoded string")
    done, name = q.encode(docs, model)
    assert done.columns == ["doc_id", "encoded", "encoded_"] and name == "encoded_"
    for row in done.select("doc_id", name, q.decoded(done[name].ids, model).alias("text")).collect():
        text = texts[row.doc_id] or ""
        assert row[name].ids == lib.encode(text, add_eos=True) and row.text == lib.decode(row[name].ids)
        assert row[name].ends[-1] == row[name].begins[-1] == len(text.encode())
    assert q.encode(docs.limit(0), model)[0].count() == 0
    assert [r.ids for r in q.encode(docs.limit(2), model, add_end=False)[0].select("encoded_.ids").collect()] == [[], []]
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in nothing.select(q.decoded(nothing.ids, model)).collect()] == ["", ""]
    with pytest.raises(ValueError):
        q.Pieces(model + field(q.TRAINER, bytes([q.SUFFIX_SPACES << 3 & 127 | 128, q.SUFFIX_SPACES >> 4, 1])))


def test_one_worker_encodes_and_decodes(spark):
    """The query's ids do not pass to a second Python worker, and its decoded text is the library's."""
    plan = q.op13_piece_encoding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    docs = spark.createDataFrame([(1, "a  b"), (2, None), (3, "é漢 x")], "doc_id long, text string")
    done, name = q.encode(docs, q.model_bytes(), back=True)
    whole = q.pieces(q.model_bytes()).whole
    assert all(r[name].back == (whole.decode(list(r[name].ids)) if r[name].ids else "") for r in done.collect())
