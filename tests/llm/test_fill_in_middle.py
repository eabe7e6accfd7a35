"""Fill-in-the-middle: a plain version of every row, exact read-back, SQL of the whole query, and cases with defined results."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from relata.llm import fill_in_middle as f

SF = "/root/testdata/sf0.001"


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert "".join(units) == text
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return text, "plain", len(units), None, None
    if h[3] % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", "spm", len(units), len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", len(units), len(p), len(m)


CASES = [None, "", "a", "The end.\n", "ünï <b>c</b>\r\n\t漢字 \U0001f600x", "<P>", "say <M> twice", "<", "<S", "S><S", "<<<PP", "M>", "ab " * 300_000, "\x00 a"]


def test_rows_and_read_back(spark):
    rows = [(k, t, "x") for k in range(40) for t in CASES[:12]] + [(None, "null id here", "x"), (7, CASES[12], "x"), (7, CASES[12], "x"), (8, CASES[13], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string")
    done, name = f.transform(docs)
    assert name == "fim_" and done.columns == ["doc_id", "text", "fim", "fim_"]
    got = done.select("doc_id", "text", "fim_", f.restored(F.col("fim_.output"), F.col("fim_.form")).alias("back")).collect()
    assert len(got) == len(rows) and {x.fim_.form for x in got} == {"plain", "psm", "spm"}
    for x in got:
        assert tuple(x.fim_)[:5] == plain(x.doc_id, x.text)
        assert x.fim_.output_sha256 == hashlib.sha256(x.fim_.output.encode()).hexdigest()
        assert x.back.text == (x.text or "") and x.back.sha256 == hashlib.sha256((x.text or "").encode()).hexdigest()
    assert f.transform(docs.limit(0))[0].count() == 0


def test_rates_and_sentinels(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    forms = lambda **o: {r[0] for r in f.transform(docs, **o)[0].select("fim.form").distinct().collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, spm=0) == {"psm"} and forms(rate=100, spm=100) == {"spm"}
    own = ("[pre]", "[suf]", "[mid]")
    done, name = f.transform(docs, sentinels=own, rate=100, seed="other")
    back = done.select(f.restored(F.col("fim.output"), F.col("fim.form"), own).alias("b"), "fim.output").collect()
    assert {r.b.text for r in back} == {"one two three"} and all("[mid]" in r.output for r in back)
    for bad in [("a", "a", "b"), ("<P>", "<S>", ""), ("aba", "<S>", "<M>"), ("<P<S", "<S>", "<M>")]:
        with pytest.raises(ValueError):
            f.transform(docs, sentinels=bad)


def test_query_equals_its_sql(spark):
    got = f.op12_fill_in_middle(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f.ORACLE).fetchall())
