"""Streams against the same computation on the whole table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from relata.streaming import panel

SCHEMA = "ts timestamp, user_id long, event_type string, value double"


def rows():
    start = dt.datetime(2024, 1, 1)
    return [(start + dt.timedelta(hours=7 * k), k % 3, "ab"[k % 2], float(k)) for k in range(90)]


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_windows_and_sessions(spark, tmp_path):
    batch = spark.createDataFrame(rows(), SCHEMA)
    batch.repartition(1).write.parquet(f"{tmp_path}/e")
    late = spark.createDataFrame([(dt.datetime(2024, 3, 1), 9, "z", 0.0)], SCHEMA)
    late.repartition(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    run(panel.windowed_dyads(stream, value="value"), "dyads")
    got = {(r.start, r.i, r.j): (r.y, r.x) for r in spark.table("dyads").collect()}
    want = batch.groupBy(F.window("ts", "7 days").start.alias("s"), "user_id", "event_type").agg(F.count("*").cast("double"), F.sum("value")).collect()
    assert got == {(r[0], str(r[1]), r[2]): (r[3], r[4]) for r in want}
    run(panel.activity_sessions(stream, gap="10 hours"), "sessions")
    assert spark.table("sessions").count() > 0


def test_forward_filter(spark, tmp_path):
    for k in range(2):
        part = [("a", 2 * k + s, float(2 * k + s)) for s in range(2)] + [("b", 2 * k, 1.0)]
        spark.createDataFrame(part, "actor string, t long, y double").repartition(1).write.mode("append").parquet(f"{tmp_path}/o")
    stream = spark.readStream.schema("actor string, t long, y double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/o")
    run(panel.forward_filter(stream, 0.5, 0.3, 2.0), "filtered")
    got = {(r.actor, r.t): (r.level, r.variance) for r in spark.table("filtered").collect()}
    level, v = 0.0, 0.3 / 0.75
    for t in range(4):
        if t:
            level, v = 0.5 * level, 0.25 * v + 0.3
        g = v / (v + 2.0)
        level, v = level + g * (t - level), (1 - g) * v
        if ("a", t) in got and all(("a", s) in got for s in range(t + 1)):
            assert got[("a", t)] == pytest.approx((level, v))
    assert ("a", 3) in got and ("b", 2) in got


def test_prediction_over_a_gap_is_exact():
    level, variance = 3.0, 2.0
    for _ in range(7):
        level, variance = 0.9 * level, 0.81 * variance + 0.3
    assert panel.ahead(3.0, 2.0, 7, 0.9, 0.3) == pytest.approx((level, variance))
    assert panel.ahead(3.0, 2.0, 0, 0.9, 0.3) == (3.0, 2.0) and panel.ahead(3.0, 2.0, 10, 1.0, 0.5) == (3.0, 7.0)
    assert panel.ahead(3.0, 2.0, 10**6, 0.9, 0.3) == pytest.approx((0.0, 0.3 / 0.19))


def test_state_is_dropped_after_the_delay(spark, tmp_path):
    """An actor that stays away begins anew; with a longer time to keep, a gap is predicted exactly, in event time."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        start, schema = dt.datetime(2024, 1, 1), "actor string, ts timestamp, t long, y double"
        day = lambda actor, k, y: (actor, start + dt.timedelta(days=k), k, y)
        for k, part in enumerate([[day("a", 0, 1.0), day("a", 1, 2.0), day("b", 0, 1.0)], [day("c", 30, 5.0)], [day("a", 31, 3.0), day("b", 2, 9.0), day("c", 31, 5.0)]]):
            spark.createDataFrame(part, schema).repartition(1).write.parquet(f"{tmp_path}/o{k}")
        import shutil
        from pathlib import Path

        Path(f"{tmp_path}/in").mkdir()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        for name, keep, anew in (("short", 7 * 86_400_000, True), ("long", 900 * 86_400_000, False)):
            q = panel.event_filter(stream, 0.5, 0.3, 2.0, "1 hour", keep).writeStream.format("memory").queryName(name).outputMode("append").start()
            for k in range(3):
                for f in Path(f"{tmp_path}/o{k}").glob("*.parquet"):
                    shutil.copy(f, f"{tmp_path}/in/{name}{k}.parquet") if name == "short" else None
                q.processAllAvailable()
            q.stop()
            got = {(r.actor, r.t): (r.level, r.variance) for r in spark.table(name).collect()}
            assert ("b", 2) not in got  # older than the watermark
            level, v, last = 0.0, 0.3 / 0.75, None
            for t, y in ((0, 1.0), (1, 2.0), (31, 3.0)):
                if t == 31 and anew:
                    level, v, last = 0.0, 0.3 / 0.75, None
                if last is not None:
                    level, v = panel.ahead(level, v, t - last, 0.5, 0.3)
                g = v / (v + 2.0)
                level, v, last = level + g * (y - level), (1 - g) * v, t
            assert got[("a", 31)] == pytest.approx((level, v))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
