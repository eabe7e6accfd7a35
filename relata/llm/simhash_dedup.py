"""SimHash near-duplicates found by meeting in the middle of Hamming balls.

Fingerprints a and b with at most three differing bits have a point v on a
shortest path between them that lies at most half the way, rounded up, from
either. Every fingerprint emits such points, they are shuffled on the point, and
fingerprints that meet at a point are verified.

Emitted are the point itself and all that differ in one bit, which meets all
pairs of up to two bits. For three bits one side has to go two steps. Those
pairs have different parity, so only fingerprints with an even number of ones
go; and of three bits two lie in the same half of the word, so only two steps
within a half are needed: 65 points for odd and 1057 for even fingerprints,
where the whole ball of radius two has 2081.

A point is a hub: the member nearest to it stands for it, and the others are
linked to that one, so the links of a dense group grow with its size and not
with its square. A meeting counts only where the distance of the two equals the
steps to the point. That loses nothing: if it is less, the two also meet on
their own shortest path, and by induction over the distance everything within
three bits is connected. As nearest members lie at most one step away, linked
members differ in at most three bits; the check of the distance verifies it.

Points travel in packed buckets by a hash of the point, whose number follows the
number of fingerprints, so no group ever meets in one bucket. Equal fingerprints
are one node; their documents come back by a join that broadcasts the few
fingerprints of very many documents. A very long text is hashed in pieces. Components are found by star contraction on written tables.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle's make one shingle; repeated rows each keep
their row; a null doc_id takes no part in a minimum and is null only for a
component without ids; empty tables give empty results; extra columns are
carried by `deduplicate` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.operators.components import star_components
from relata.llm.frames import fresh, split_join, table
from relata.llm.words import mix, utf8
from relata.session import written

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Points that meet in one bucket, about, while BUCKETS are enough; then up to eight times as many, and only then more buckets.
BUCKET = 1 << 19
BUCKETS = 1 << 16
#: Fingerprints whose points are packed together, at least; about 18 points of a pack go to each bucket.
PACK = 2048
#: Fingerprints that one task emits the points of.
FED = 1 << 15

_ONE = [1 << k for k in range(64)]
_TWO = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
MASKS = np.array([0, *_ONE, *_TWO], np.uint64)
STEPS = np.array([0] + [1] * 64 + [2] * len(_TWO), np.int8)
NEAR = 65

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(octets) < 64:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    counts = np.bincount((octets + np.arange(0, 2048, 256, dtype=np.int64)).ravel(), minlength=2048).reshape(8, 256)
    return (counts @ _BITS).ravel()


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED, at_once: int = 1 << 18) -> int:
    """The SimHash of a text in UTF-8 over the XXH64 of its word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, at_once):
        parts = zip(begins[k : min(n, k + at_once)].tolist(), last[k : k + at_once].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in parts], np.uint64)
        counts += bit_counts(hashes)
    return sum(1 << int(k) for k in np.flatnonzero(counts * 2 > n))


def fingerprints(docs: DataFrame, text_col: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """docs with a long column `name` in place of the text."""
    at = docs.columns.index(text_col)
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.limit(0).select(*kept, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            raw = data.tobytes()
            marks = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
            columns = [batch.column(k) for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks.view(np.int64))], names=[*kept, name])

    return docs.mapInArrow(run, schema)


def bucket_count(count: int) -> int:
    """Buckets for the points of so many fingerprints, 561 of each."""
    points = count * 561
    return max(1, min(-(-points // BUCKET), max(BUCKETS, -(-points // (8 * BUCKET)))))


def emit(n_buckets: int):
    """Points of all fingerprints, packed by bucket; `mask` tells the step that leads back."""
    pack = max(PACK, n_buckets * PACK // BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(marks), pack):
                part = marks[k : k + pack]
                even = np.bitwise_count(part) % 2 == 0
                points = np.concatenate([(part[:, None] ^ MASKS[:NEAR]).ravel(), (part[even][:, None] ^ MASKS[NEAR:]).ravel()])
                steps = np.concatenate([np.tile(np.arange(NEAR, dtype=np.uint16), len(part)), np.tile(np.arange(NEAR, len(MASKS), dtype=np.uint16), int(even.sum()))])
                bucket = (mix(points) % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                points, steps = points[order], steps[order]
                bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                full = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full.astype(np.int32)),
                        pa.array([points[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary()),
                        pa.array([steps[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary()),
                    ],
                    names=["bucket", "points", "steps"],
                )

    return run


def meet(points: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that meet at a point: each member with the nearest one, if the point is on their shortest path."""
    order = np.argsort(points, kind="stable")
    points, steps = points[order], steps[order]
    same = points[1:] == points[:-1]
    shared = np.zeros(len(points), bool)
    shared[1:] |= same
    shared[:-1] |= same
    points, steps = points[shared], steps[shared]
    marks, far = points ^ MASKS[steps], STEPS[steps]
    order = np.lexsort((marks, far, points))
    points, marks, far = points[order], marks[order], far[order]
    head = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]])) if len(points) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, len(points)))
    nearest, nearest_far = np.repeat(marks[head], sizes), np.repeat(far[head], sizes)
    on_path = (np.bitwise_count(marks ^ nearest) == far + nearest_far) & (far + nearest_far <= RADIUS) & (marks != nearest)
    return nearest[on_path], marks[on_path]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links as it takes to connect what the links a, b connect: every node with the least of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[below]], nodes[below]


def meetings(group: pa.Table) -> pa.Table:
    points = np.frombuffer(b"".join(group.column("points").to_pylist()), np.uint64)
    steps = np.frombuffer(b"".join(group.column("steps").to_pylist()), np.uint16)
    a, b = forest(*meet(points, steps))
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def ball_links(marks: DataFrame, count: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints of the one-column table `marks` with RADIUS or fewer differing bits; marks are distinct."""
    n_buckets = bucket_count(count)
    spread = marks.repartition(max(1, -(-count // FED)), "mark")
    packed = spread.mapInArrow(emit(n_buckets), "bucket int, points binary, steps binary")
    return packed.groupBy("bucket").applyInArrow(meetings, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    marked = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "mark"), "fingerprints")
    nodes = written(marked.groupBy("mark").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    tree = star_components(ball_links(nodes.select("mark"), nodes.count()))
    tree = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
    linked = tree.join(nodes, tree["node"] == nodes["mark"]).select("node", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select(F.col("node").alias("mark"), "component")
    final = written(nodes.join(named, "mark", "left").select("mark", "n", F.coalesce("component", "least").alias("component_id")), "final")
    return split_join(marked, final, "mark", "n").select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the least id; rows without an id stay, as nothing names them.

    Of rows that share the least id one stays: the one with the least hash of all its columns.
    """
    groups = written(near_duplicates(docs, id_col, text_col), "groups")
    kept = groups.where("doc_id = component_id").select("doc_id").groupBy("doc_id").count()
    repeated = kept.where("count > 1").select("doc_id")
    key = fresh(docs, "_kept_id")
    stay = docs.join(kept.select(F.col("doc_id").alias(key)), docs[id_col] == F.col(key), "left_semi")
    rest = docs.where(F.col(id_col).isNull())
    if repeated.isEmpty():
        return stay.unionByName(rest)
    again = repeated.select(F.col("doc_id").alias(key))
    once = stay.join(again, stay[id_col] == F.col(key), "left_anti")
    mark = fresh(docs, "_row_hash")
    many = stay.join(again, stay[id_col] == F.col(key), "left_semi").dropDuplicates().withColumn(mark, F.xxhash64(*docs.columns))
    first = many.groupBy(id_col).agg(F.min(mark).alias(mark))
    picked = many.join(first, [id_col, mark], "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return once.unionByName(picked).unionByName(rest)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
