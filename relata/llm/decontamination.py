"""Benchmark decontamination with suffix arrays over the training texts.

Every slice of a partition's texts is a shard with a suffix array over its
words: the positions of all suffixes that can begin a match, in the order of
the words that follow. A suffix can begin a match only if its first words
occur in this order in some test item, so the array leaves out the others.
Each distinct window that begins a test suffix is looked up by binary search; the range
found holds all its occurrences in the shard. Occurrences and test suffixes are then
extended together, word by word, in groups that share all words so far, to the longest verbatim match:
work is their number and not the number of their pairs. Words are found by 64-bit hashes; those of
every occurrence are compared byte by byte with the test set's.

The plan is one map over the documents: no shuffle, no key, and therefore no
skew. The test set is written in blocks of about `block_words` words to the shared folder; workers
read one after the other, and keep them only if they are few, so a larger set takes more time and not more memory.
A very long text is a shard of its own.

Defined results: a null text has no words; a text or an item without words is
never hit and hits nothing; an item without an id hits but is not listed; rows
with equal ids are judged one by one; an item id that occurs with several texts
counts once; an empty test set hits nothing; extra columns are carried by
`decontaminate` and never read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.frames import batch_of, fresh, table
from relata.llm.words import LOWER, keyed_word_hashes, mix, placed_word_hashes, slices, text_offsets, utf8
from relata.session import scratch_path

WINDOW = 10
#: Words of a suffix's beginning that must occur in the test set; fewer if an item is shorter.
LEAD = 4
SHARD_BYTES = 2 << 20
#: Text that a block is read for, where there are too many to be held.
GROUP_BYTES = 16 << 20
BLOCK_WORDS = 1 << 20
#: Blocks that a worker may hold.
HELD_BLOCKS = 2
#: A sieve has so many places for each key, 256 to 512, up to 4 MB.
_SIEVE_SPARE_BITS, _SIEVE_MOST_BITS = 8, 22

SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_at long, longest_item string"


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1 and so on, n of each."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class NeedleBlock:
    """Some test items: their words, the windows that begin in them, and the search keys. Equal windows are one, with a list of places and a set of items."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int, seeds: Iterable[int] | None = None):
        data, offsets = utf8(pa.array(texts, pa.string()))
        _, lengths, bounds, starts = placed_word_hashes(data, offsets)
        # the first seed under which no two of these words have one hash; nearly always the first of all
        for self.seed in count() if seeds is None else seeds:
            words = keyed_word_hashes(data, starts, lengths, self.seed)
            # the distinct words as bytes, to verify what hashes find
            self.known, first = np.unique(words, return_index=True)
            self.known_size = lengths[first]
            self.known_at = np.cumsum(self.known_size) - self.known_size
            self.known_bytes = LOWER[data[spread(starts[first], self.known_size)]]
            if not len(self.unlike(data, starts, lengths, words, np.arange(len(words)))):
                break
        self.ids, self.words, self.window = ids, words, window
        sizes = np.diff(bounds)
        item = np.repeat(np.arange(len(texts)), sizes)
        self.item, self.end = item, np.repeat(bounds[1:], sizes)
        width = np.minimum(np.repeat(sizes, sizes), window)
        at = np.arange(len(words))
        at = at[at + width <= self.end]
        width = width[at]
        self.lead = int(min(LEAD, width.min())) if len(at) else 0
        if not self.lead:
            return
        self.leads = np.unique(lead_keys(words, self.lead)[at])
        # the distinct windows, their places in order, and the items that have them
        low, one, uid = np.unique(suffix_keys(words, at, at + width, window, 0), return_index=True, return_inverse=True)
        self.width = width[one]
        order = np.argsort(uid, kind="stable")
        self.places, self.place_of = at[order], np.searchsorted(uid[order], np.arange(len(low) + 1))
        pairs = np.unique(uid.astype(np.int64) * len(texts) + item[at])
        uid, item = pairs // len(texts), pairs % len(texts)
        with np.errstate(over="ignore"):
            marks = mix(item.astype(np.uint64) + np.uint64(1))
            total = np.add.reduceat(marks, np.searchsorted(uid, np.arange(len(low))))
        first_item = np.searchsorted(uid, np.arange(len(low) + 1))
        _, one, self.set_of = np.unique(total, return_index=True, return_inverse=True)
        self.sets = [item[first_item[u] : first_item[u + 1]] for u in one]
        self.make_keys()

    def make_keys(self) -> None:
        """The sieve and the windows as search keys, which follow from the rest and are larger than it; files of blocks are without them."""
        bits = min(_SIEVE_MOST_BITS, len(self.leads).bit_length() + _SIEVE_SPARE_BITS)
        self.shift, self.sieve = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.sieve[(self.leads >> self.shift).astype(np.int64)] = True
        at = self.places[self.place_of[:-1]]
        self.low = suffix_keys(self.words, at, at + self.width, self.window, 0)
        self.high = self.low if self.width.min() == self.window else suffix_keys(self.words, at, at + self.width, self.window, 0xFFFFFFFFFFFFFFFF)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("shift", "sieve", "low", "high")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        if self.lead:
            self.make_keys()

    def unlike(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Those of the words `which`, all with a known hash, that are other words than the known ones."""
        known = np.searchsorted(self.known, words[which])
        same = lengths[which] == self.known_size[known]
        n = lengths[which][same]
        differ = LOWER[data[spread(starts[which][same], n)]] != self.known_bytes[spread(self.known_at[known][same], n)]
        return np.union1d(which[~same], np.unique(np.repeat(which[same], n)[differ]))


def lead_keys(words: np.ndarray, n: int) -> np.ndarray:
    """For each position a key of the n words from there on; the last n - 1 positions get one that no window has."""
    key = np.zeros(len(words), np.uint64)
    if len(words) >= n:
        with np.errstate(over="ignore"):
            total = np.zeros(len(words) - n + 1, np.uint64)
            for k in range(n):
                total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
        key[: len(total)] = mix(total)
    return key


def suffix_keys(words: np.ndarray, at: np.ndarray, end: np.ndarray, window: int, pad: int) -> np.ndarray:
    """The first words of each suffix as bytes whose order is the order of the words."""
    keys = np.empty((len(at), window), ">u8")
    for k in range(window):
        keys[:, k] = np.where(at + k < end, words[np.minimum(at + k, max(len(words) - 1, 0))], np.uint64(pad))
    return keys.view(f"S{8 * window}").ravel()


def occurrences(block: NeedleBlock, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each occurrence of a distinct window in a shard: word position there, number of the window, and the text's end."""
    none = np.zeros(0, np.int64)
    if not block.lead or len(words) < block.lead:
        return none, none, none
    lead = lead_keys(words, block.lead)
    kept = np.flatnonzero(block.sieve[(lead >> block.shift).astype(np.int64)])
    kept = kept[np.isin(lead[kept], block.leads)]
    if not len(kept):
        return none, none, none
    ends = bounds[np.searchsorted(bounds, kept, "right")]
    kept, ends = kept[kept + block.lead <= ends], ends[kept + block.lead <= ends]
    keys = suffix_keys(words, kept, ends, block.window, 0)
    order = np.argsort(keys, kind="stable")
    keys, kept, ends = keys[order], kept[order], ends[order]
    left, right = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    found = spread(left, right - left)
    return kept[found], np.repeat(np.arange(len(left)), right - left), ends[found]


def covered(at: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in an occurrence."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def longest(block: NeedleBlock, words: np.ndarray, at: np.ndarray, uid: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the words of its longest verbatim match, and the first place in the test block that has it.

    Occurrences and places with the same words so far are one group, which the next word divides; no pair of them is made.
    """
    size, where = block.width[uid].copy(), np.zeros(len(at), np.int64)
    group, uses = np.unique(uid), None
    n = block.place_of[group + 1] - block.place_of[group]
    place, of = block.places[spread(block.place_of[group], n)], np.repeat(np.arange(len(group)), n)
    length = block.width[group]
    alive, label = np.arange(len(at)), np.searchsorted(group, uid)
    while len(alive):
        first = np.full(len(length), len(block.words), np.int64)
        np.minimum.at(first, of, place)
        where[alive], size[alive] = first[label], length[label]
        a, t = at[alive] + length[label], place + length[of]
        on_a, on_t = a < end[alive], t < block.end[place]
        alive, label, a, place, of, t = alive[on_a], label[on_a], a[on_a], place[on_t], of[on_t], t[on_t]
        with np.errstate(over="ignore"):
            next_a = mix(words[a] + label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            next_t = mix(block.words[t] + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        uses = np.intersect1d(next_a, next_t)
        on_a, on_t = np.isin(next_a, uses), np.isin(next_t, uses)
        grown = np.zeros(len(uses), np.int64)
        grown[np.searchsorted(uses, next_a[on_a])] = length[label[on_a]] + 1
        alive, label = alive[on_a], np.searchsorted(uses, next_a[on_a])
        place, of, length = place[on_t], np.searchsorted(uses, next_t[on_t]), grown
    return size, where


class Shard:
    """The texts of one shard, and what the blocks of the test set found in them so far."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = utf8(texts)
        _, self.lengths, self.bounds, self.starts = placed_word_hashes(self.data, offsets)
        self.hashes = {}
        n = len(texts)
        self.hit = np.zeros(len(self.starts), bool)
        self.best, self.best_at, self.best_item = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
        self.items: dict[int, set[str]] = {}

    def meet(self, block: NeedleBlock) -> None:
        words = self.hashes.get(block.seed)
        if words is None:
            words = self.hashes[block.seed] = keyed_word_hashes(self.data, self.starts, self.lengths, block.seed)
        at, uid, end = occurrences(block, words, self.bounds)
        while len(at):
            inside = covered(at, block.width[uid], len(words))
            other = block.unlike(self.data, self.starts, self.lengths, words, np.flatnonzero(inside))
            if not len(other):
                break
            words = words.copy()
            words[other] = 0  # no word of this block's items
            at, uid, end = occurrences(block, words, self.bounds)
        if not len(at):
            return
        self.hit |= inside
        doc = np.searchsorted(self.bounds, at, "right") - 1
        several = np.unique(doc * np.int64(len(block.sets)) + block.set_of[uid])
        held, which = several // len(block.sets), several % len(block.sets)
        first = np.flatnonzero(np.diff(held, prepend=-1))
        for b, e in zip(first, np.append(first[1:], len(held))):
            found = np.unique(np.concatenate([block.sets[k] for k in which[b:e]]))
            self.items.setdefault(int(held[b]), set()).update(block.ids[i] for i in found if block.ids[i] is not None)
        # a match begun at a place is at most as long as the run of windows from there
        starts = np.unique(at)
        run = np.cumsum(np.diff(starts, prepend=-2) > 1)
        last = starts[np.append(np.flatnonzero(np.diff(run)), len(starts) - 1)]
        place = np.searchsorted(starts, at)
        bound = last[run[place] - 1] - at + block.window
        todo = (place == 0) | (run[place] != run[np.maximum(place - 1, 0)])
        for rest in (todo, ~todo):
            rest = np.flatnonzero(rest & (bound > self.best[doc]))
            size, where = longest(block, words, at[rest], uid[rest], end[rest])
            order = np.lexsort((where, at[rest], -size, doc[rest]))
            for k in order[np.flatnonzero(np.diff(doc[rest][order], prepend=-1))]:
                d = doc[rest[k]]
                if size[k] > self.best[d]:
                    self.best[d], self.best_at[d], self.best_item[d] = size[k], at[rest[k]] - self.bounds[d], block.ids[block.item[where[k]]]

    def columns(self) -> dict[str, pa.Array]:
        n = len(self.best)
        inside = np.concatenate([[0], np.cumsum(self.hit)])
        n_hit = inside[self.bounds[1:]] - inside[self.bounds[:-1]]
        listed = [sorted(self.items.get(d, ())) for d in range(n)]
        nothing = hashlib.sha256(b"").hexdigest()
        return {
            "n_words": pa.array(np.diff(self.bounds)),
            "n_hit": pa.array(n_hit),
            "n_items": pa.array([len(x) for x in listed], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else nothing for x in listed]),
            "contaminated": pa.array(n_hit > 0),
            "longest_words": pa.array(self.best),
            "longest_at": pa.array(self.best_at, mask=self.best == 0),
            "longest_item": pa.array(self.best_item, pa.string()),
        }


class Needles:
    """The test set in files of the shared folder, a block in each; a worker holds several only if there are few."""

    def __init__(self, folder: str, names: list[str], held: int = HELD_BLOCKS):
        self.folder, self.names, self.held = folder, names, held

    def blocks(self, cache: dict[str, NeedleBlock]) -> Iterator[NeedleBlock]:
        store, path = fs.FileSystem.from_uri(self.folder)
        for name in self.names:
            block = cache.get(name)
            if block is None:
                with store.open_input_stream(f"{path}/{name}") as file:
                    block = pickle.loads(file.read())
                if len(self.names) <= self.held:
                    cache[name] = block
            yield block


def needle_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Needles:
    """The test set in blocks of about `block_words` words, each built and written by a task.

    Files have a name of their own per attempt, and only those that the job returns are ever read.
    """
    folder = scratch_path(benchmark.sparkSession, "needles")
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    words = rows.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            store.create_dir(path, recursive=True)
            name = f"block-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{path}/{name}") as file:
                file.write(pickle.dumps(NeedleBlock(ids, texts, window)))
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        for batch in batches:
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                texts.append(t)
                size += len(t) // 2 + 1
                if size >= 2 * block_words:
                    yield close()
                    ids, texts, size = [], [], 0
        if texts:
            yield close()

    dealt = rows.repartition(max(1, math.ceil(words / block_words)), F.xxhash64("i", "t"))
    return Needles(folder, sorted(r["name"] for r in dealt.mapInArrow(run, "name string").collect()))


def annotate(docs: DataFrame, benchmark: DataFrame, prefix: str = "", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the columns of SCHEMA added, each named with `prefix`; a prefix that makes one clash with a column of docs is an error."""
    added = [(prefix + name, kind) for name, kind in (x.split() for x in SCHEMA.split(", "))]
    clash = {n.lower() for n, _ in added} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"give another prefix: {sorted(clash)} would be there twice")
    needles = needle_blocks(benchmark, item_col, item_text, window, block_words)
    at = docs.columns.index(text_col)
    schema = docs.limit(0).select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in added]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, NeedleBlock] = {}
        for batch in batches:
            for low, high in slices(text_offsets(batch.column(at)), GROUP_BYTES):
                group = batch.slice(low, high - low)
                parts = [group.slice(b, e - b) for b, e in slices(text_offsets(group.column(at)), SHARD_BYTES)]
                shards = [Shard(part.column(at)) for part in parts]
                for block in needles.blocks(cache):
                    for shard in shards:
                        shard.meet(block)
                for part, shard in zip(parts, shards):
                    yield batch_of(dict(zip(batch.schema.names, part.columns)) | {prefix + k: v for k, v in shard.columns().items()})

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that no test window occurs in, with the columns of docs."""
    prefix = fresh(docs, "_decon")
    marked = annotate(docs, benchmark, prefix=f"{prefix}_", **options)
    return marked.where(~F.col(f"{prefix}_contaminated")).select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = annotate(docs, table(spark, sf_dir, "benchmark"))
    return marked.drop("text")
