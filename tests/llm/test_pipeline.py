"""The pipeline, stage by stage, against what each stage must keep, drop and change."""

import re

import pytest

import corpus_pipeline as c
from relata.llm import decontamination, simhash_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for number, (_, stage) in enumerate(c.STAGES):
        docs = c.written(stage(spark, docs, SF), f"test{number}")
        out.append(docs.collect())
    return out


def test_rows_and_columns(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(c.STAGES) == 5 and all(list(rows[0].asDict()) == columns for rows in stages[:5])
    ids = [[r.doc_id for r in rows] for rows in stages]
    for before, after in zip(ids, ids[1:]):
        assert set(after) <= set(before) and len(set(after)) == len(after)
    assert len(ids[1]) > 0.7 * len(ids[0]) and len(ids[4]) == len(ids[3])


def test_one_of_each_group_stays(stages):
    marks = {r.doc_id: simhash_dedup.fingerprint((r.text or "").encode()) for r in stages[1]}
    parent = {d: d for d in marks}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(marks)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(marks[a] ^ marks[b]).count("1") <= 3:
                a_root, b_root = find(a), find(b)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    assert sorted(r.doc_id for r in stages[2]) == sorted({find(d) for d in ids})


def test_no_benchmark_window_stays_and_the_rest_does(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    from test_decontamination import words

    windows = {tuple(v[p : p + 10]) for _, t in items for v in [words(t)] for p in range(max(1, len(v) - 9)) if v}
    short = {w for w in windows if len(w) < 10}
    assert not short

    def hit(text):
        w = words(text)
        return any(tuple(w[q : q + 10]) in windows for q in range(len(w) - 9))

    assert sorted(r.doc_id for r in stages[3]) == sorted(r.doc_id for r in stages[2] if not hit(r.text))
    assert decontamination.WINDOW == 10


def test_personal_data_is_gone_and_clean_texts_are_the_same(stages):
    before, after = ({r.doc_id: r.text for r in rows} for rows in stages[3:5])
    personal = re.compile(r"\S+@mail\d|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-f]{40}\b")
    for doc, text in after.items():
        found = [m.group() for m in personal.finditer(before[doc])]
        assert not [f for f in found if f in text]
        if not re.search(r"[0-9@]", before[doc]) and "Mr" not in before[doc]:
            assert text == before[doc]


def test_run_is_the_stages_in_order(spark, stages):
    got = sorted((r.doc_id, r.taken) for r in c.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.taken) for r in stages[5])


def test_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
