"""Approximate nearest neighbours: a navigable small-world graph per shard.

Vectors are dealt by a hash of their id to shards of about SHARD_BYTES. Each shard
gets a hierarchical graph: a node is in layer l and all below with the usual
geometric chance, and in each layer has links to near nodes that are nearer to it
than to one another, filled up with the nearest ones, plus the links back. Nodes
are inserted, those of high layers first, in batches of at most a tenth of the graph: a batch
walks the graph built so far, and sees its own members by exact distances.
Equal vectors are one node with a list of ids, so copies neither fill
a node's links nor the result list.

The index is a table with a row per shard: ids, vectors and flat neighbour arrays
as binary columns. Every valid row is in it. Queries are packed in blocks, each
block goes to every shard by an equi join on the shard, a batch of queries
walks the layers together, and the shards' best are ranked per query. Work per
query and shard is bounded by `ef`; a shard's memory is bounded by its bytes.

Defined results: rows whose id is null, or whose vector is null, empty, zero or
with null or non-finite components, take no part; vectors of other lengths are
searched among themselves; a row repeated with id and vector counts once; a
query's own id is left out; fewer candidates than k give fewer rows; equal
distances go to the smaller id; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm.frames import table
from relata.llm.words import mix
from relata.session import written

#: Bytes of a shard's vectors in single precision, about: 32,768 rows of 64 components.
SHARD_BYTES = 8 << 20
QUERY_BLOCK = 256
#: Links that a node makes in each layer; it holds twice as many in the lowest.
LINKS = 16
#: Near nodes that an insertion walks for.
CANDIDATES = 40
#: Near nodes that a search walks for in the lowest layer, and an insertion in layers above a node's own.
EF = 256
EF_ABOVE = 4
#: Nodes whose links are followed at once.
AT_ONCE = 12
#: Components of vectors that are worked on at once.
WORKED = 1 << 21
#: Nodes that are inserted at once, at most.
BATCH = 1024
SEED = 2011

INDEX = "dim int, shard int, ids binary, starts binary, vectors binary, sizes binary, links binary"


def valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def narrow(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Vectors in single precision, to walk by; distances of the result are computed from the originals."""
    return np.ascontiguousarray(np.clip(vectors / scale, -1e15, 1e15).astype(np.float32))


def pieces(n: int, width: int) -> list[tuple[int, int]]:
    """Ranges of n rows of so many components that are worked on at once."""
    step = max(1, WORKED // max(1, width))
    return [(b, min(n, b + step)) for b in range(0, n, step)]


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, at_once: int, visits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries at once, `at_once` nodes of each at a time; the ef best nodes of each, nearest first, -1 where there are fewer."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    best = np.full((q, ef), n, np.int32)
    dist = np.full((q, ef), np.inf, np.float32)
    done = np.ones((q, ef), bool)

    def add(rows: np.ndarray, new: np.ndarray) -> None:
        new = np.sort(np.where(new < 0, n, new), axis=1)
        fresh = ~seen[rows[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[rows[:, None], new] = True
        if visits is not None:
            visits[rows] += fresh.sum(1)
        r, c = np.nonzero(fresh)
        d = np.full(new.shape, np.inf, np.float32)
        for b, e in pieces(len(r), x.shape[1]):
            there = x[new[r[b:e], c[b:e]]]
            there -= queries[rows[r[b:e]]]
            d[r[b:e], c[b:e]] = np.einsum("ij,ij->i", there, there)
        all_d, all_new, all_done = np.concatenate([dist[rows], d], 1), np.concatenate([best[rows], new.astype(np.int32)], 1), np.concatenate([done[rows], ~fresh], 1)
        kept = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        dist[rows] = np.take_along_axis(all_d, kept, 1)
        best[rows] = np.take_along_axis(all_new, kept, 1)
        done[rows] = np.take_along_axis(all_done, kept, 1)

    add(np.arange(q), entry)
    at_once = min(at_once, ef)
    while True:
        open_ = np.where(done, np.inf, dist)
        at = np.argpartition(open_, at_once - 1, axis=1)[:, :at_once]
        there = np.isfinite(np.take_along_axis(open_, at, 1))
        rows = np.flatnonzero(there.any(1))
        if not len(rows):
            break
        at, there = at[rows], there[rows]
        done[rows[:, None], at] = True
        nodes = best[rows[:, None], at]
        around = np.where(there[:, :, None], links[np.minimum(nodes, n - 1)], -1)
        add(rows, around.reshape(len(rows), -1).astype(np.int64))
    order = np.argsort(dist, axis=1, kind="stable")
    best, dist = np.take_along_axis(best, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isinf(dist), -1, best).astype(np.int64), dist


def diverse(x: np.ndarray, near: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates, nearest first and -1 where there are fewer, `width`: those nearer to the node than to one taken before, then the nearest others."""
    if near.size * x.shape[1] > WORKED and len(near) > 1:
        return np.concatenate([diverse(x, near[b:e], dist[b:e], width) for b, e in pieces(len(near), near.shape[1] * x.shape[1])])
    there = x[np.maximum(near, 0)]
    norms = np.einsum("qcd,qcd->qc", there, there)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(there, there.transpose(0, 2, 1))
    real, taken, count = near >= 0, np.zeros(near.shape, bool), np.zeros(len(near), int)
    for hiding in (True, False):
        for k in range(near.shape[1]):
            now = real[:, k] & ~taken[:, k] & (count < width)
            if hiding:
                now &= ~(taken & (between[:, :, k] < dist[:, k : k + 1])).any(1)
            taken[:, k] |= now
            count += now
    out = np.full((len(near), width), -1, np.int32)
    rank = np.cumsum(taken, axis=1) - 1
    r, k = np.nonzero(taken)
    out[r, rank[r, k]] = near[r, k]
    return out


def within(x: np.ndarray, new: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest others among a batch of nodes that are inserted together."""
    v = x[new]
    norms = np.einsum("ij,ij->i", v, v)
    d = np.maximum(norms[:, None] + norms[None, :] - 2 * (v @ v.T), 0)
    np.fill_diagonal(d, np.inf)
    c = min(most, len(new) - 1)
    if c < 1:
        return np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0), np.float32)
    k = np.argpartition(d, c - 1, axis=1)[:, :c]
    return new[k], np.take_along_axis(d, k, 1).astype(np.float32)


def link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, own: np.ndarray) -> None:
    """Adds to the nodes that `new` were linked to the links back; a node with too many keeps diverse ones."""
    most = links.shape[1]
    to, from_ = own.ravel(), np.repeat(new, own.shape[1])
    order = np.lexsort((from_, to))
    to, from_ = to[order], from_[order]
    to, from_ = to[to >= 0], from_[to >= 0]
    nodes, first, number = np.unique(to, return_index=True, return_counts=True)
    for b in range(0, len(nodes), BATCH):
        node, n = nodes[b : b + BATCH], number[b : b + BATCH]
        more = np.full((len(node), n.max()), -1, np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        more[np.repeat(np.arange(len(node)), n), place] = from_[first[b] : first[b] + n.sum()]
        held = np.sort(np.concatenate([links[node].astype(np.int64), more], 1), axis=1)[:, ::-1]
        held[:, 1:][held[:, 1:] == held[:, :-1]] = -1
        held = np.sort(held, axis=1)[:, ::-1]
        if held.shape[1] <= most or not (held[:, most] >= 0).any():
            links[node, : min(most, held.shape[1])] = held[:, :most]
            continue
        d = np.full(held.shape, np.inf, np.float32)
        for lo, hi in pieces(len(node), held.shape[1] * x.shape[1]):
            there = x[np.maximum(held[lo:hi], 0)]
            there -= x[node[lo:hi]][:, None, :]
            d[lo:hi] = np.where(held[lo:hi] >= 0, np.einsum("qcd,qcd->qc", there, there), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        kept, over = held[:, :most].copy(), held[:, most] >= 0
        kept[over] = diverse(x, np.take_along_axis(held, order, 1)[over], np.take_along_axis(d, order, 1)[over], most)
        links[node] = kept


def grow(x: np.ndarray, counts: list[int]) -> list[np.ndarray]:
    """The links of each layer, whose nodes are the first counts[layer] of x; nodes are inserted in batches of at most a tenth of the graph.

    Each batch walks down from the top layer; in each layer that a node belongs to, it is linked to diverse ones of
    the nearest nodes that the walk finds and of the nearest within the batch.
    """
    layers = [np.full((n, 2 * LINKS if layer == 0 else LINKS), -1, np.int32) for layer, n in enumerate(counts)]
    at = 0
    while at < len(x):
        new = np.arange(at, min(len(x), at + min(BATCH, max(LINKS, at // 10))))
        entry = np.zeros((len(new), 1), np.int64)
        for layer in range(len(counts) - 1, -1, -1):
            links, old = layers[layer], min(at, counts[layer])
            here = new[new < counts[layer]]
            found, dist = np.zeros((len(here), 0), np.int64), np.zeros((len(here), 0), np.float32)
            if old:
                walked = np.full((len(new), CANDIDATES), -1, np.int64)
                passing = np.arange(len(here), len(new))
                if len(passing):
                    walked[passing, :EF_ABOVE] = beam(x[:old], links[:old], x[new[passing]], entry[passing], EF_ABOVE, 2)[0]
                if len(here):
                    found, dist = beam(x[:old], links[:old], x[here], entry[: len(here)], CANDIDATES, AT_ONCE)
                    walked[: len(here)] = found
                entry = np.where(walked < 0, walked[:, :1], walked)[:, :LINKS]
            if len(here):
                beside, apart = within(x, here, LINKS)
                found, dist = np.concatenate([found, beside], 1), np.concatenate([dist, apart], 1)
                order = np.argsort(dist, axis=1, kind="stable")[:, :CANDIDATES]
                own = diverse(x, np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1), LINKS)
                links[here, :LINKS] = own
                link_back(x, links, here, own)
        at = int(new[-1]) + 1
    return layers


def build(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays of a shard's graph: nodes in the order of insertion, a layer's first; sizes: nodes and links a node of each layer; links: their neighbours, layer by layer."""
    vectors = vectors + 0.0
    nodes, at = np.unique(vectors, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([at.ravel(), ids]), axis=1)
    at, ids = pairs[0], pairs[1]
    first = np.searchsorted(at, np.arange(len(nodes) + 1))
    drawn = mix(ids[first[:-1]].view(np.uint64) ^ np.uint64(SEED))
    level = np.floor(-np.log(np.maximum((drawn >> np.uint64(11)).astype(float) / (1 << 53), 1e-18)) / np.log(LINKS)).astype(int)
    order = np.lexsort((drawn, -level))
    nodes, number = nodes[order], np.diff(first)[order]
    ids = ids[np.repeat(first[:-1][order], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)]
    counts = [int((level >= layer).sum()) for layer in range(level.max() + 1 if len(level) else 0)]
    scale = np.array([np.abs(nodes).max()])
    layers = grow(narrow(nodes, scale[0]), counts)
    return {"ids": ids.astype(np.int64), "starts": np.concatenate([[0], np.cumsum(number)]).astype(np.int64), "vectors": nodes, "sizes": np.array([x.shape for x in layers], np.int64), "links": np.concatenate([x.ravel() for x in layers])}


def search(index: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF, visits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard's k best for each query: query id, id, distance. `visits` is added the nodes that each query looked at."""
    x, sizes = index["vectors"], index["sizes"]
    scale = np.abs(x).max()
    near, asked = narrow(x, scale), narrow(queries, scale)
    first_link = np.concatenate([[0], np.cumsum(sizes[:, 0] * sizes[:, 1])])
    entry = np.zeros((len(queries), 1), np.int64)
    for layer in range(len(sizes) - 1, -1, -1):
        n, most = sizes[layer]
        links = index["links"][first_link[layer] : first_link[layer + 1]].reshape(n, most)
        entry, _ = beam(near[:n], links, asked, entry, max(ef, k + 1) if layer == 0 else 2 * EF_ABOVE, AT_ONCE, visits)
        if layer:
            entry = np.where(entry < 0, entry[:, :1], entry)[:, :EF_ABOVE]
    row, col = np.nonzero(entry >= 0)
    node = entry[row, col]
    # summed component by component, so that the score is that of a plain loop to the last digit
    d = np.sqrt(np.cumsum((x[node] - queries[row]) ** 2, axis=1)[:, -1])
    n = np.minimum(np.diff(index["starts"])[node], k + 1)
    place = np.repeat(index["starts"][node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, d, ids = np.repeat(row, n), np.repeat(d, n), index["ids"][place]
    other = ids != query_ids[row]
    row, d, ids = row[other], d[other], ids[other]
    order = np.lexsort((ids, d, row))
    row, d, ids = row[order], d[order], ids[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return query_ids[row[kept]], ids[kept], d[kept]


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def tasks_for(shards: int | None) -> int:
    """Partitions that so many shards are dealt to: few of them hold two. Without a number of its own a small table would be joined to one task."""
    return max(1, min(2 * (shards or 0), 20_000))


def build_index(vectors: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index table of vectors (vec_id, vector array<double>)."""
    dims = written(vectors.groupBy(F.size("vector").alias("dim")).agg(F.ceil(F.count("*") * F.size("vector") * 4 / shard_bytes).cast("int").alias("shards")), "shards")
    n = tasks_for(dims.agg(F.sum("shards")).first()[0])
    dealt = vectors.withColumn("dim", F.size("vector")).join(dims, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.col("shards")).cast("int"))

    def make(key: tuple, group: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[1].as_py()
        made = build(group.column("vec_id").to_numpy(), matrix(group.column("vector"), dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32())} | {c: pa.array([a.tobytes()], pa.binary()) for c, a in made.items()})

    return dealt.select("dim", "shard", "vec_id", "vector").repartition(n, "dim", "shard").groupBy("dim", "shard").applyInArrow(make, INDEX)


def opened(row: dict, dim: int) -> dict[str, np.ndarray]:
    get = lambda c, kind: np.frombuffer(row[c], kind)
    return {"ids": get("ids", np.int64), "starts": get("starts", np.int64), "vectors": get("vectors", np.float64).reshape(-1, dim), "sizes": get("sizes", np.int64).reshape(-1, 2), "links": get("links", np.int32)}


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query row by Euclidean distance."""
    rows = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    index = written(build_index(rows, shard_bytes), "hnsw")
    queries = rows.where(is_query).dropDuplicates().withColumn("dim", F.size("vector"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        return pa.table({"dim": pa.array([dim], pa.int32()), "query_ids": pa.array([group.column("vec_id").to_numpy().tobytes()], pa.binary()), "queries": pa.array([matrix(group.column("vector"), dim).tobytes()], pa.binary())})

    dealt = queries.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).select("dim", "block", "vec_id", "vector")
    packed = dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, query_ids binary, queries binary")
    sent = packed.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    n = tasks_for(index.count())
    met = sent.repartition(n, "dim", "shard").join(index.repartition(n, "dim", "shard"), ["dim", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                dim = row["dim"]
                found = search(opened(row, dim), np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["queries"], np.float64).reshape(-1, dim), k, ef)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda k: (q.e[k] - c.e[k]) * (q.e[k] - c.e[k])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
