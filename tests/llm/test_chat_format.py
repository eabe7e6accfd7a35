"""Chat formatting: exact round trips, all layouts, and a plain computation of the digests."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from relata.llm import chat_format as c

LAYOUTS = [
    ("turn", {"role": "user", "text": "a", "turn": 3}, [("user", "a")]),
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ("conversations", {"id": 7, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
    ("prompt", {"prompt": "p", "completion": "c", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ("instruction", {"instruction": "i", "input": "x", "output": "o"}, [("user", "i"), ("user", "x"), ("assistant", "o")]),
    ("instruction", {"instruction": "i", "output": "o", "id": "k"}, [("user", "i"), ("assistant", "o")]),
    ("question", {"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ("nested", {"data": {"input": {"text": "q"}, "output": {"text": "a"}}}, [("user", "q"), ("assistant", "a")]),
    ("unknown", {"prompt": "p", "completion": "c", "other": 1}, []),
    ("unknown", {"messages": []}, []),
]
TEXTS = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\\\|", "<\\|im_end|>", "\\n<|", "a\nb\\", "<<||>", "é漢😀<|im_end|>", "|im_end|>\n", "<"]


def test_every_layout_is_selected_by_its_fingerprint(spark):
    rows = [(i, 0, json.dumps(r)) for i, (_, r, _) in enumerate(LAYOUTS)] + [(90, 0, None), (91, 0, "{not json"), (92, 0, "[1, 2]")]
    frame = spark.createDataFrame(rows, "k int, o int, record string")
    got = {}
    for r in c.canonical(frame, ["k"], ["o"]).collect():
        got.setdefault(r.k, (r.layout, []))[1].append((r.seq, r.role, r.text))
    for i, (layout, _, turns) in enumerate(LAYOUTS):
        assert got[i][0] == layout, i
        assert [x[1:] for x in sorted(got[i][1]) if x[0] is not None] == turns if turns else got[i][1] == [(None, "", "")]
    assert all(got[k] == ("unknown", [(None, "", "")]) for k in (90, 91, 92))


def test_shapes_in_python_and_sql_agree(spark):
    frame = spark.createDataFrame([(json.dumps(r),) for _, r, _ in LAYOUTS[:8]], "record string").withColumn("v", F.parse_json("record"))
    got = [r.s for r in frame.select(c.schema_text(F.col("v")).alias("s")).collect()]
    assert got[1] == c._paths(("messages[].role", "messages[].content")) and got[7] == c._paths(("data.output.text", "data.input.text"))
    marks = frame.select(c.fingerprint(c.schema_text(F.col("v"))).alias("m")).collect()
    assert [r.m for r in marks] == [c.fingerprint_of(s) for s in got]


def test_round_trip_and_digests(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["user", "assistant", "system", "odd\nrole\\n<|", None]), rng.choice([*TEXTS, None])) for i in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, None, "user", "x"), (50, 1, "assistant", "y"), (50, 1, "assistant", "y"), (None, 0, "assistant", "z"), (51, 0, "assistant", "<|" * 30_000), (-1, 0, "user", "real")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, c.op7_chat_format(spark, str(tmp_path)).collect()), key=str)
    want = []
    groups = {}
    for i, t, role, text in rows:
        groups.setdefault((i, 0), []).append((t is not None, t or 0, role or "", text or ""))
    groups[(-1, 1)] = [(True, 0, "user", c.HOSTILE), (True, 1, "assistant", c.HOSTILE)]
    size = lambda s: len(s) + s.count("\\") + s.count("<|")
    for (i, _), turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        total = sum(24 + size(r) + r.count("\n") + size(x) for *_, r, x in turns)
        want.append((i, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), total))
    assert got == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string, record string, seq int").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in c.op7_chat_format(spark, str(tmp_path)).collect()] == [-1]


def test_a_very_long_turn_is_whole(spark, tmp_path):
    n = 21_000_000
    long = spark.range(1).select("id", F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), F.lit(n)).alias("text"))
    long.withColumnRenamed("id", "conv_id").write.parquet(f"{tmp_path}/conversations.parquet")
    row = next(r for r in c.op7_chat_format(spark, str(tmp_path)).collect() if r.conv_id == 0)
    text = "x" * n
    assert (row.n_turns, row.loss_chars, row.formatted_chars) == (1, n, n + 24 + len("assistant"))
    assert row.turns_sha256 == hashlib.sha256(f"assistant\n{text}\n".encode()).hexdigest() and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_a_record_too_long_to_parse_is_an_error(spark):
    record = F.concat(F.lit('{"role": "user", "text": "'), F.repeat(F.lit("x"), F.lit(21_000_000)), F.lit('"}'))
    frame = spark.range(1).select(F.col("id").alias("k"), F.lit(0).alias("o"), record.alias("record"))
    with pytest.raises(Exception, match="does not parse"):
        c.canonical(frame, ["k"], ["o"]).select(F.length("text")).collect()
