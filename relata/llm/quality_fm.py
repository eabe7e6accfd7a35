"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

score = logistic(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), where the
pairs cost linear time by the identity
sum over pairs = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Features: word counts, logarithmic, hashed and of length one per text; shares of
byte classes, sizes and repetition of the text, each in bins at quantiles of the
learned sample; and metadata columns, binned likewise, with a bin for missing
values. The language, the source, the id and the labels are no inputs.

The model is fitted on the driver on at most about `fit_rows` labelled rows,
taken by a hash of the id; the sample is the only thing that is broadcast or
collected, and its size does not depend on the corpus. Scoring is one map over
whole texts with the model in a broadcast.

Defined results: null and empty texts are scored like any text, without words;
rows without a label, with a null one, or with several that differ are not
learned from; without any label the score is 0.5; repeated rows each get their
row; missing metadata columns count as missing values; extra columns are carried
by `keep_good` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.frames import fresh, remainder, table
from relata.llm.words import slices, text_offsets, utf8, word_hashes

FIT_ROWS = 12_000
WORD_BITS = 15
BINS = 12
FACTORS = 8
STEPS = 1500
SEED = 977
THRESHOLD = 0.3
#: Text that is scored at once; arrays of about forty times its size are made for it.
SLICE_BYTES = 1 << 20

#: Bytes by class; all others of ASCII are in class 0, and those of other characters in the last.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t\x0b\x0c", b".,;:", b"|", b"#$%&*", b"!?", b"<>", b"\"'`", b"(){}[]=+/\\@_~^-"]
CLASS = np.zeros(256, np.int64)
for _k, _members in enumerate(_CLASSES):
    CLASS[list(_members)] = _k + 1
CLASS[128:] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2
N_STATISTICS = N_CLASSES + 6


def word_features(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct hashed word of each text: text, feature, weight; and per text the largest count."""
    n = len(bounds) - 1
    keys = np.repeat(np.arange(n, dtype=np.int64) << WORD_BITS, np.diff(bounds)) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    text, feature = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)
    weight = np.log1p(counts)
    length = np.sqrt(np.bincount(text, weight * weight, n))
    most = np.zeros(n)
    np.maximum.at(most, text, counts)
    return text, feature, weight / length[text], most


def statistics(data: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, distinct: np.ndarray, most: np.ndarray) -> np.ndarray:
    """One row of structure statistics per text."""
    n, size, words = len(offsets) - 1, np.diff(offsets), np.diff(bounds)
    held = np.bincount(np.repeat(np.arange(n) * N_CLASSES, size) + CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    total = np.concatenate([[0], np.cumsum(lengths)])
    some, letters = np.maximum(size, 1), np.maximum(words, 1)
    more = [np.log1p(size), np.log1p(words), (total[bounds[1:]] - total[bounds[:-1]]) / letters, distinct / letters, most / letters, held[:, 5] / letters]
    return np.column_stack([held / some[:, None], *more])


def extract(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and weight of the words, and the statistics."""
    data, offsets = utf8(texts)
    hashes, lengths, bounds = word_hashes(data, offsets)
    text, feature, weight, most = word_features(hashes, bounds)
    distinct = np.bincount(text, minlength=len(texts))
    return text, feature, weight, statistics(data, offsets, lengths, bounds, distinct, most)


class Machine:
    """Parameters and bin edges of a fitted machine."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        n = (1 << WORD_BITS) + len(edges) * (BINS + 1)
        rng = np.random.default_rng(SEED)
        self.bias, self.w, self.v = 0.0, np.zeros(n, np.float32), rng.normal(0, 0.05, (n, FACTORS)).astype(np.float32)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Features of the statistics and metadata: one for each column; the last bin is for missing values."""
        columns = []
        for k, edges in enumerate(self.edges):
            column = values[:, k]
            bin_of = np.where(np.isnan(column), BINS, np.searchsorted(edges, column, "right"))
            columns.append((1 << WORD_BITS) + k * (BINS + 1) + bin_of)
        return np.column_stack(columns)

    def rows(self, n: int, text: np.ndarray, feature: np.ndarray, weight: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins = self.binned(values)
        scale = 2 / np.sqrt(bins.shape[1])
        text = np.concatenate([text, np.repeat(np.arange(n), bins.shape[1])])
        order = np.argsort(text, kind="stable")
        return text[order], np.concatenate([feature, bins.ravel()])[order], np.concatenate([weight, np.full(bins.size, scale)])[order].astype(np.float32)

    def raw(self, n: int, text: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value before the logistic, and the factor sums; every text has a feature, so every range is full."""
        first = np.searchsorted(text, np.arange(n))
        vx = self.v[feature] * x[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), first)
        return self.bias + np.add.reduceat(self.w[feature] * x, first) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, n: int, text: np.ndarray, feature: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(n, text, feature, x)[0].astype(np.float64), -35, 35)))


def rows_of(m: Machine, parts: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and weights of all rows, one after the other, and where each begins: its words, then its bins."""
    bins = m.binned(values).astype(np.int32)
    scale = np.full(bins.shape[1], 2 / np.sqrt(bins.shape[1]), np.float32)
    starts = np.concatenate([[0], np.cumsum([len(f) + bins.shape[1] for f, _ in parts])])
    features = np.concatenate([a for (f, _), b in zip(parts, bins) for a in (f, b)])
    weights = np.concatenate([a for _, x in parts for a in (x, scale)])
    return starts, features, weights


def train(parts: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-5, batch: int = 128) -> Machine:
    """Adagrad on logistic loss. parts: features and weights of each text's words."""
    quantiles = np.linspace(0, 1, BINS)[1:-1]
    edges = []
    for k in range(values.shape[1]):
        known = values[~np.isnan(values[:, k]), k]
        some = known[known > 0]
        edges.append(np.unique(np.append(np.quantile(some, quantiles), some.min())) if len(some) else np.zeros(0))
    m = Machine(edges)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    m.bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(m.w.shape, 1e-3, np.float32), np.full(m.v.shape, 1e-3, np.float32), 1e-3
    starts, features, weights = rows_of(m, parts, values)
    sizes = np.diff(starts)
    held, place_of = np.zeros(len(m.w), bool), np.zeros(len(m.w), np.int64)
    rng = np.random.default_rng(SEED)
    for _ in range(-(-steps * batch // len(labels))):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            n = len(rows)
            text = np.repeat(np.arange(n), sizes[rows])
            at = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(sizes[rows])[:-1]]), sizes[rows]) + np.arange(len(text))
            feature = features[at]
            held[feature] = True
            used = np.flatnonzero(held)
            held[used] = False
            place_of[used] = np.arange(len(used))
            # dense over the features that the batch uses: at most 128 x 33,000 values
            x = np.zeros((n, len(used)), np.float32)
            x[text, place_of[feature]] = weights[at]
            squared, w, v = x * x, m.w[used], m.v[used]
            sums = x @ v
            raw = m.bias + x @ w + 0.5 * ((sums * sums).sum(axis=1) - squared @ (v * v).sum(axis=1))
            error = ((1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[rows]) / n).astype(np.float32)
            dw = x.T @ error + decay * w
            dv = x.T @ (error[:, None] * sums) - (squared.T @ error)[:, None] * v + decay * v
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w[used] -= (rate * dw / np.sqrt(gw[used])).astype(np.float32)
            m.v[used] -= (0.3 * rate * dv / np.sqrt(gv[used])).astype(np.float32)
            db = float(error.sum())
            gb += db * db
            m.bias -= rate * db / gb**0.5
    return m


def metadata_of(docs: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    return [(F.col(c).cast("double") if c in docs.columns else F.lit(None).cast("double")).alias(fresh(docs, f"_meta{k}")) for k, c in enumerate(columns)]


def _values(batch: pa.RecordBatch, first: int, found: np.ndarray) -> np.ndarray:
    extra = [np.log1p(np.maximum(batch.column(k).to_numpy(zero_copy_only=False).astype(float), 0)) for k in range(first, batch.num_columns)]
    return np.column_stack([found, *extra]) if extra else found


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",), fit_rows: int = FIT_ROWS) -> Machine | None:
    """A machine for the labels of usable ids; None if there are none."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.where(usable).groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("k", "y")
    count = known.count()
    if count > fit_rows:
        known = known.where(F.pmod(F.xxhash64("k", F.lit(SEED)), F.lit(1 << 20)) < (1 << 20) * fit_rows // count)
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), *metadata_of(docs, metadata))
    rows = rows.join(F.broadcast(known), F.col("i") == F.col("k").cast("string")).select("i", "y", "t", *[fresh(docs, f"_meta{k}") for k in range(len(metadata))])
    # one row of each id, the same in every run; else an id that very many rows share would make the sample unbounded
    names = rows.columns
    rows = rows.groupBy("i").agg(F.min_by(F.struct(*names), F.struct(F.xxhash64(*names), F.col("t"))).alias("r")).select("r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(b, e - b) for whole in batches for b, e in slices(text_offsets(whole.column(2)), SLICE_BYTES)):
            text, feature, weight, found = extract(batch.column(2))
            values = _values(batch, 3, found)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            cut = lambda a, kind: pa.array([a[b:e].astype(kind).tobytes() for b, e in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cut(feature, np.int32), cut(weight, np.float32), pa.array([v.tobytes() for v in values], pa.binary())], names=["i", "y", "f", "x", "v"])

    sample = sorted(rows.mapInArrow(run, "i string, y int, f binary, x binary, v binary").collect(), key=lambda r: (r["i"], r["f"], r["x"]))
    if not sample:
        return None
    parts = [(np.frombuffer(r["f"], np.int32), np.frombuffer(r["x"], np.float32)) for r in sample]
    return train(parts, np.stack([np.frombuffer(r["v"]) for r in sample]), np.array([r["y"] for r in sample], float))


def score(docs: DataFrame, machine: Machine | None, name: str = "score", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), keep_text: bool = False) -> DataFrame:
    """docs with a score, and without the text unless it is kept."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if keep_text or c != text_col]
    model = spark.sparkContext.broadcast(machine)
    wide = docs.select(*kept, F.col(text_col).alias(fresh(docs, "_scored_text")), *metadata_of(docs, metadata))
    at = len(kept)
    schema = docs.limit(0).select(*kept, F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for begin, end in slices(text_offsets(whole.column(at)), SLICE_BYTES):
                batch = whole.slice(begin, end - begin)
                n = batch.num_rows
                if m is None:
                    scores = np.full(n, 0.5)
                else:
                    text, feature, weight, found = extract(batch.column(at))
                    scores = m.score(n, *m.rows(n, text, feature, weight, _values(batch, at + 1, found)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(at)], pa.array(scores, pa.float64())], names=[*kept, name])

    return wide.mapInArrow(run, schema)


def keep_good(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with at least this score, with the columns of docs."""
    name = fresh(docs, "_score")
    return score(docs, machine, name, keep_text=True).where(F.col(name) >= threshold).select(*docs.columns)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Machine | None:
    """The production model: labels of the table beside the documents, all but the held-out fifth."""
    return fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("k"), 5) != 0)


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text", "n_chars")
    scored = score(rows, fitted(spark, docs, sf_dir)).drop("n_chars")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
