"""Runs of repeated phrases: stretches of words with a period, found by harmonic grid probing.

A run of period p is a stretch in which words p apart are equal, p being the
least such number, and which no neighbouring word extends. One that is at least
three periods long holds three neighbouring multiples of p, so it is enough to
look at words jp and (j+1)p for each p: n/1 + n/2 + n/3 + ... probes, n log n in
all. Points whose neighbour passes too are survivors, and each is extended to
both sides by comparing slices of doubling length, until words differ.

A point within a found run is skipped if p is a multiple of that run's period:
its stretch is that run again. So a text of one word only costs its probes and
one extension, not one for each period.

The work is one map over whole texts without a shuffle. Words are numbered within
a slice of texts of bounded size, so equality of numbers is equality of words,
and grids of many periods and texts are probed by the same array operations, in
blocks of bounded length.

Defined results: a null text, or one without a word, has no runs and an empty
collapsed text; repeated rows each get their row; runs are ordered by start,
then period, and may overlap; a very long text is a slice of its own and needs
some 150 bytes a word; extra columns are carried and not read,
and the results are struct fields of one column whose name is changed by
underscores if it is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm.frames import fresh, table
from relata.llm.words import slices, text_offsets

MIN_LENGTH = 24
MIN_PERIODS = 3
#: Bytes of text that are worked on together, and grid points that are probed together.
SLICE = 4 << 20
POINTS = 1 << 20
#: Words that the first slice of an extension compares.
FIRST = 64

RUNS = "array<struct<start: long, length: long, period: long>>"


def matched(w: np.ndarray, at: int, period: int, stop: int) -> int:
    """The first i from `at` on with w[i] unlike w[i + period], or stop - period."""
    step, end = FIRST, stop - period
    while at < end:
        k = min(step, end - at)
        unlike = w[at : at + k] != w[at + period : at + period + k]
        first = int(unlike.argmax())
        if unlike[first]:
            return at + first
        at += k
        step *= 2
    return end


def matched_back(w: np.ndarray, at: int, period: int, stop: int) -> int:
    """The least i with w[i] to w[at] like the words a period later, not below stop."""
    step = FIRST
    while at > stop:
        k = min(step, at - stop)
        unlike = w[at - k : at] != w[at - k + period : at + period]
        last = int(unlike[::-1].argmax())
        if unlike[k - 1 - last]:
            return at - last
        at -= k
        step *= 2
    return stop


def _grid(starts: np.ndarray, counts: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid points of all rows and their periods: starts + j * periods for j below counts."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    p = np.repeat(periods, counts)
    return np.repeat(starts, counts) + (np.arange(total) - np.repeat(first, counts)) * p, p


def _blocks(sizes: np.ndarray, periods_in_a_run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (text, period, number of points) with periods that never fall, about POINTS points in each block.

    `sizes` falls; a text takes part while a run of `periods_in_a_run` periods fits.
    """
    if not len(sizes) or sizes[0] < periods_in_a_run:
        return
    last = int(sizes[0]) // periods_in_a_run
    fits = np.searchsorted(-sizes, -periods_in_a_run * np.arange(1, last + 1), "right")
    total = np.concatenate([[0], np.cumsum(sizes)])
    weights = np.cumsum(total[fits] // np.arange(1, last + 1))
    p = 1
    while p <= last:
        done = weights[p - 2] if p > 1 else 0
        end = max(p + 1, int(np.searchsorted(weights, done + POINTS, "right")) + 1)
        end = min(end, last + 1)
        each = fits[p - 1 : end - 1]
        periods = np.repeat(np.arange(p, end), each)
        texts = np.arange(len(periods)) - np.repeat(np.cumsum(each) - each, each)
        counts = (sizes[texts] - 1) // periods - 1
        yield texts, periods, np.maximum(counts, 0)
        p = end


def runs_in(w: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text; text k is w[bounds[k]:bounds[k + 1]].

    `min_periods` is 3 at least: less would not hold three points of the grid.
    """
    if min_periods < MIN_PERIODS:
        raise ValueError("a run of fewer than three periods can miss the grid")
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    order = order[: int((lengths >= min_length).sum())]
    sizes, begins = lengths[order], bounds[:-1][order]
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(lengths))]
    covered = np.zeros(len(w), np.int64)
    covered_to = np.zeros(len(w), np.int64)
    for texts, periods, counts in _blocks(sizes, min_periods):
        at, p = _grid(begins[texts], counts, periods)
        same = w[at] == w[at + p]
        at, p = at[same], p[same]
        same = w[at + p] == w[at + 2 * p]
        at, p = at[same], p[same]
        half = at + p // 2
        same = w[half] == w[half + p]
        at, p = at[same], p[same]
        if not len(at):
            continue
        inside = (covered_to[at] >= at + 2 * p) & (p % np.maximum(covered[at], 1) == 0)
        at, p = at[~inside], p[~inside]
        text = np.searchsorted(bounds, at, "right") - 1
        held, until = (-1, 0), -1
        for g, period, k in zip(at.tolist(), p.tolist(), text.tolist()):
            if held == (k, period) and g < until:
                continue
            if covered_to[g] >= g + 2 * period and period % covered[g] == 0:
                continue
            until = matched(w, g, period, int(bounds[k + 1]))
            held = (k, period)
            start = matched_back(w, g, period, int(bounds[k]))
            length = until + period - start
            if length < max(min_length, min_periods * period) or (start, length) in found[k]:
                continue
            found[k][start, length] = period
            covered[start : start + length] = period
            covered_to[start : start + length] = start + length
    return [sorted((s - int(bounds[k]), n, q) for (s, n), q in runs.items()) if runs else [] for k, runs in enumerate(found)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _result(rows: list[tuple[int, list[tuple[int, int, int]], bytes]]) -> pa.StructArray:
    flat = np.array([r for _, runs, _ in rows for r in runs], np.int64).reshape(-1, 3)
    ends = np.cumsum([0] + [len(runs) for _, runs, _ in rows])
    triples = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
    return pa.StructArray.from_arrays(
        [pa.array([n for n, _, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), triples), pa.array([t for _, _, t in rows], pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"]
    )


def find(docs: DataFrame, text_col: str = "text", name: str = "found", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, arrange: tuple[str, Callable[[object, int], np.ndarray | None]] | None = None) -> tuple[DataFrame, str]:
    """docs without the text, with a struct of n_words, runs and the collapsed text, and the name of its column.

    `arrange` names a column and has a function of its value and the number of
    words that says which words are read instead, by number, or None.
    """
    name = fresh(docs, name)
    at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if k != at]
    key = docs.columns.index(arrange[0]) if arrange else None
    result = T.StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string")
    schema = T.StructType([*[docs.schema[k] for k in kept], T.StructField(name, result)])

    def words_of(batch: pa.RecordBatch, k: int) -> list[bytes]:
        words = (batch.column(at)[k].as_py() or "").encode().split()
        if arrange and (picked := arrange[1](batch.column(key)[k].as_py(), len(words))) is not None:
            words = [words[i] for i in picked]
        return words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(text_offsets(batch.column(at)), SLICE):
                texts = [words_of(batch, k) for k in range(begin, end)]
                number: dict[bytes, int] = {}
                w = np.fromiter((number.setdefault(x, len(number)) for words in texts for x in words), np.int32)
                found = runs_in(w, np.cumsum([0] + [len(words) for words in texts]), min_length, min_periods)
                rows = [(len(words), runs, collapsed(words, runs)) for words, runs in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(begin, end - begin) for k in kept], _result(rows)], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema), name


def planted(key: object, n: int) -> np.ndarray | None:
    """Which words stand for a text of n words: one in ten, by the CRC-32 of its id, goes on by repeating a phrase."""
    from zlib import crc32

    h = crc32(str("" if key is None else key).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def strongest(runs: Column) -> Column:
    """The run with the greatest length in periods, compared exactly; the first by start, then period, of equals."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(better(best, r), r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = find(table(spark, sf_dir, "documents").select("doc_id", "text"), arrange=("doc_id", planted))
    runs = F.col(f"{name}.runs")
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.select("doc_id", name, strongest(runs).alias("best"))
    return best.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(f"{name}.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
