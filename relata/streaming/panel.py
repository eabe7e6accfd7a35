"""Network panels from event streams.

Not part of the batch models: events are counted per pair and window under a
watermark, and a stateful forward filter follows each actor's level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def windowed_dyads(events: DataFrame, time: str = "ts", i: str = "user_id", j: str = "event_type", period: str = "7 days", delay: str = "1 day", value: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, i, j, y[, x]) per window: counts, and sums of a value; events later than the delay are left out."""
    window = F.window(time, period, slide) if slide else F.window(time, period)
    sums = [F.sum(value).alias("x")] if value else []
    counted = events.withWatermark(time, delay).groupBy(window.alias("w"), F.col(i).cast("string").alias("i"), F.col(j).cast("string").alias("j")).agg(F.count("*").cast("double").alias("y"), *sums)
    return counted.select(F.col("w.start").alias("start"), "i", "j", "y", *(["x"] if value else []))


def activity_sessions(events: DataFrame, time: str = "ts", actor: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(actor, start, end, n): runs of an actor's events with no gap as long as this."""
    s = F.session_window(time, gap)
    made = events.withWatermark(time, delay).groupBy(s.alias("s"), F.col(actor).cast("string").alias("actor")).agg(F.count("*").alias("n"))
    return made.select("actor", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


FILTERED = "actor string, t long, level double, variance double"
STATE = "level double, variance double, t long"


def ahead(level: float, variance: float, steps: int, rho: float, state_variance: float) -> tuple[float, float]:
    """Mean and variance of an autoregressive level after any number of steps, in closed form."""
    decay = rho**steps
    spread = float(steps) if abs(rho) == 1 else (1 - decay * decay) / (1 - rho * rho)
    return decay * level, decay * decay * variance + state_variance * spread


def forward_filter(observations: DataFrame, rho: float = 0.9, state_variance: float = 0.1, noise: float = 1.0) -> DataFrame:
    """Kalman filter of an autoregressive level per actor, over a stream of (actor, t, y); the state is three numbers per actor.

    Observations of one batch are taken in order of t; older ones than the state are left out, as the filter has passed them.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, variance, last = state.get if state.exists else (0.0, state_variance / max(1 - rho * rho, 1e-9), None)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, y in zip(rows["t"], rows["y"]):
            if last is not None and t < last:
                continue
            if last is not None:
                level, variance = ahead(level, variance, int(t - last), rho, state_variance)
            gain = variance / (variance + noise)
            level, variance, last = level + gain * (y - level), (1 - gain) * variance, t
            out.append((key[0], int(t), float(level), float(variance)))
        if last is not None:
            state.update((float(level), float(variance), int(last)))
        yield pd.DataFrame(out, columns=["actor", "t", "level", "variance"])

    return observations.groupBy("actor").applyInPandasWithState(run, FILTERED, STATE, "append", "NoTimeout")


class LevelFilter(StatefulProcessor):
    """The forward filter of one actor, with an event-time timer that drops the state of one that stays away."""

    def __init__(self, rho: float, state_variance: float, noise: float, keep_ms: int):
        self.rho, self.state_variance, self.noise, self.keep_ms = rho, state_variance, noise, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("level", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        begins = (0.0, self.state_variance / max(1 - self.rho**2, 1e-9), None)
        level, variance, last = self.state.get() if self.state.exists() else begins
        table, out = pd.concat(list(rows)).sort_values("t", kind="stable"), []
        table = table[table["ts"] >= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")]
        if table.empty:
            yield pd.DataFrame(out, columns=["actor", "t", "level", "variance"])
            return
        for t, y in zip(table["t"], table["y"]):
            if last is not None and t < last:
                continue
            if last is not None:
                level, variance = ahead(level, variance, int(t - last), self.rho, self.state_variance)
            gain = variance / (variance + self.noise)
            level, variance, last = level + gain * (y - level), (1 - gain) * variance, int(t)
            out.append((key[0], last, float(level), float(variance)))
        self.state.update((float(level), float(variance), int(last)))
        # one timer an actor: the latest event of any batch sets it anew
        latest = int(table["ts"].max().timestamp() * 1000) + self.keep_ms
        for timer in list(self.handle.listTimers()):
            latest = max(latest, timer)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest)
        yield pd.DataFrame(out, columns=["actor", "t", "level", "variance"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.state.clear()
        yield pd.DataFrame([], columns=["actor", "t", "level", "variance"])

    def close(self) -> None:
        pass


def event_filter(observations: DataFrame, rho: float = 0.9, state_variance: float = 0.1, noise: float = 1.0, delay: str = "1 hour", keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """The forward filter over a stream of (actor, ts, t, y), where t is the step that ts falls in.

    An actor's state is dropped once the watermark, the latest event less `delay`, is `keep_ms` past their last event; one
    that comes back begins anew. A gap of any number of steps is predicted in closed form. Observations that are older
    than the watermark, or than the actor's state, are left out. The session's state store has to be RocksDB.
    """
    keyed = observations.select("actor", "ts", "t", "y").withWatermark("ts", delay).groupBy("actor")
    return keyed.transformWithStateInPandas(statefulProcessor=LevelFilter(rho, state_variance, noise, keep_ms), outputStructType=FILTERED, outputMode="Append", timeMode="EventTime")
