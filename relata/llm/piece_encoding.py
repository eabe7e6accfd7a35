"""SentencePiece encoding with byte spans of the original text, and decoding.

A model's file holds a compiled character map: a double-array trie whose keys are
strings and whose values are places of their replacements. `Normaliser` reads
it, replaces the longest key at each place, treats spaces as the model asks for,
and records for each byte of the result at which byte of the original text the
character begins that it came from. The segmentation into pieces is the
library's, on the normalised text, with the model's own normalisation turned
off. Piece lengths, summed up, are places in the normalised text, and the record
projects them to byte spans of the original: [begin, end), in order, without a gap.
A character that falls back to several byte pieces gives its span to the last.

Both ways are maps over whole texts without a shuffle; texts are encoded in slices
of bounded size. The model's bytes are read once on the driver and go to the tasks
with the function, so workers need the library but not the file.

Defined results: a null text counts as empty and has only the end id, if one is
asked for; ids that are null decode to an empty text; repeated rows each get
their row; a very long text is a slice of its own and needs about 30 bytes a byte of
text; characters that the model does not know become byte pieces, or the unknown
id where the model has none; extra columns are carried and not read, and the
results are struct fields of one column whose name is changed by underscores if
it is taken. Models that put the space symbol behind words are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm.frames import fresh, table
from relata.llm.words import slices, text_offsets

#: Bytes of text that are encoded together.
SLICE = 1 << 20
#: Fixed values of the model's file format: numbers of fields, and kinds of pieces.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES, SUFFIX_SPACES, BYTE_FALLBACK = 2, 3, 4, 5, 24, 35
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
SPACE = "▁".encode()


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: numbers as int, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def trie_entries(units: np.ndarray) -> list[tuple[bytes, int]]:
    """Keys and values of a double-array trie, a level of all nodes at a time.

    A unit holds its label in bits 0 to 7 (bit 31 marks a value), whether a value
    hangs below in bit 8, and the offset to its children in bits 10 to 30, times
    256 if bit 9 is set. A child sits at offset XOR label.
    """

    def children(at: np.ndarray) -> np.ndarray:
        unit = units[at]
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    out: list[tuple[bytes, int]] = []
    base, keys = children(np.zeros(1, np.int64)), [b""]
    labels = np.arange(1, 256)
    while len(base):
        child = base[:, None] ^ labels[None, :]
        there = child < len(units)
        there &= (units[np.where(there, child, 0)] & (0x80000000 | 0xFF)) == labels
        parent, label = np.nonzero(there)
        at = child[parent, label]
        keys = [keys[p] + bytes([c + 1]) for p, c in zip(parent.tolist(), label.tolist())]
        base = children(at)
        for k in np.flatnonzero(units[at] & 256).tolist():
            out.append((keys[k], int(units[base[k]] & 0x7FFFFFFF)))
    return out


def character_map(compiled: bytes) -> dict[str, bytes]:
    """Replacements by key: four bytes of the trie's size, the trie, then texts that each end with a zero."""
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64)
    texts = compiled[4 + size :]
    return {key.decode(): texts[at : texts.index(0, at)] for key, at in trie_entries(units)}


class Normaliser:
    """Longest-prefix replacement and treatment of spaces, with the source of every byte."""

    def __init__(self, replacements: dict[str, bytes], user_defined: tuple[str, ...] = (), dummy_prefix: bool = True, extra_spaces: bool = True, escape: bool = True):
        self.dummy_prefix, self.remove_extra, self.space = dummy_prefix, extra_spaces, SPACE if escape else b" "
        self.tables = [t for t in ({u: u.encode() for u in user_defined}, replacements) if t]
        self.sizes: list[dict[str, list[int]]] = []
        for t in self.tables:
            sizes: dict[str, set[int]] = {}
            for key in t:
                sizes.setdefault(key[0], set()).add(len(key))
            self.sizes.append({c: sorted(s, reverse=True) for c, s in sizes.items()})
        firsts = "".join(sorted({c for s in self.sizes for c in s}))
        self.first = re.compile("[" + re.escape(firsts) + "]") if firsts else None

    def _longest(self, text: str, at: int) -> tuple[int, bytes] | None:
        """Characters of the longest key at a place, and what stands for it; symbols of the user go first."""
        for known, sizes in zip(self.tables, self.sizes):
            for n in sizes.get(text[at], ()):
                if (found := known.get(text[at : at + n])) is not None and at + n <= len(text):
                    return n, found
        return None

    def _chunks(self, text: str) -> Iterator[tuple[bytes, int, bool]]:
        """Result, bytes of the original, and whether they are the same."""
        at = 0
        while self.first and (m := self.first.search(text, at)):
            begin = m.start()
            while (found := self._longest(text, begin)) is None:
                m = self.first.search(text, begin + 1)
                if not m:
                    break
                begin = m.start()
            if found is None:
                break
            if begin > at:
                same = text[at:begin].encode()
                yield same, len(same), True
            n, replaced = found
            yield replaced, len(text[begin : begin + n].encode()), False
            at = begin + n
        if at < len(text):
            same = text[at:].encode()
            yield same, len(same), True

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and where in the original each came from; one more entry is the end."""
        total = len(text.encode())
        chunks = list(self._chunks(text))
        made = np.array([len(r) for r, _, _ in chunks], np.int64)
        taken = np.array([n for _, n, _ in chunks], np.int64)
        same = np.array([s for _, _, s in chunks], bool)
        data = np.frombuffer(b"".join(r for r, _, _ in chunks), np.uint8)
        inner = np.arange(len(data)) - np.repeat(np.cumsum(made) - made, made)
        copied = np.repeat(same, made)
        begins = np.where(copied, (data & 0xC0) != 0x80, inner == 0)
        source = np.repeat(np.cumsum(taken) - taken, made) + np.where(copied, inner, 0)
        source = np.maximum.accumulate(np.where(begins, source, 0)) if len(source) else source
        lead = 0
        if self.remove_extra and len(data):
            for r, n, s in chunks:
                k = len(r) - len(r.lstrip(b" ")) if s else int(r == b" ") and n
                lead += k
                if not s and not k or s and k < len(r):
                    break
            if lead == total:
                return b"", np.array([total])
            blank = data == 32
            unit = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            spaces = np.concatenate([[0], np.cumsum(blank)])
            leading = spaces[1:] - spaces[unit] == np.arange(len(data)) - unit + 1
            after = np.where(unit == 0, True, blank[np.maximum(unit - 1, 0)])
            keep = ~(leading & after)
            data, source = data[keep], source[keep]
        if not len(text):
            return b"", np.zeros(1, np.int64)
        wide = np.where(data == 32, len(self.space), 1)
        prefix = self.space if self.dummy_prefix else b""
        normal = prefix + data.tobytes().replace(b" ", self.space)
        align = np.concatenate([np.full(len(prefix), lead, np.int64), np.repeat(source, wide), [total]])
        if self.remove_extra:
            end = len(normal)
            while normal.endswith(self.space, 0, end):
                end -= len(self.space)
            normal, align = normal[:end], align[: end + 1]
        return normal, align


class Pieces:
    """A model: its normaliser, the library's segmentation of normalised texts, and its decoder."""

    def __init__(self, model: bytes):
        import sentencepiece

        pieces = [dict(message(v)) for k, v in message(model) if k == PIECE]
        trainer, spec = ({k: v for part in message(model) if part[0] == n for k, v in message(part[1])} for n in (TRAINER, NORMALIZER))
        if trainer.get(SUFFIX_SPACES):
            raise ValueError("models with the space symbol behind words are not covered")
        users = tuple(p[1].decode() for p in pieces if p.get(3, NORMAL) == USER_DEFINED)
        self.normalise = Normaliser(character_map(spec.get(CHARSMAP, b"")), users, bool(spec.get(DUMMY_PREFIX, 1)), bool(spec.get(EXTRA_SPACES, 1)), bool(spec.get(ESCAPE_SPACES, 1)))
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.sizes = np.array([1 if p.get(3, NORMAL) == BYTE else len(p[1]) for p in pieces]) if trainer.get(BYTE_FALLBACK) else None
        # A later value of a field replaces the earlier: no character map, no prefix, no removal and no escape of spaces.
        off = bytes([CHARSMAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, EXTRA_SPACES << 3, 0, ESCAPE_SPACES << 3, 0])
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(off)]) + off)

    def encode(self, texts: list[str], add_end: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, and begin and end of each in the bytes of the original."""
        for text in texts:
            normal, align = self.normalise(text)
            shown = normal.decode()
            ids = np.array(self.plain.encode(shown, num_threads=1), np.int32)
            if self.sizes is not None:
                sizes = self.sizes[ids]
            else:
                sizes = np.array([len(p.encode()) for p in self.plain.encode(shown, out_type=str)], np.int64)
            cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            if cuts[-1] != len(normal):
                raise RuntimeError(f"pieces of {cuts[-1]} bytes for a normalised text of {len(normal)}")
            spans = align[cuts]
            if add_end:
                ids = np.append(ids, np.int32(self.whole.eos_id()))
                spans = np.append(spans, len(text.encode()))
            yield ids, spans[:-1], spans[1:]


@lru_cache(maxsize=4)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", name: str = "encoded", add_end: bool = True, back: bool = False) -> tuple[DataFrame, str]:
    """docs without the text, with a struct of ids, begins and ends (bytes of the text), and the name of its column.

    With `back` the struct has the text decoded from the ids as well; one worker a task does both, and ids do not go to a second.
    """
    name = fresh(docs, name)
    at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if k != at]
    result = T.StructType.fromDDL("ids array<int>, begins array<long>, ends array<long>" + (", back string" if back else ""))
    schema = T.StructType([*[docs.schema[k] for k in kept], T.StructField(name, result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model)
        for batch in batches:
            for begin, end in slices(text_offsets(batch.column(at)), SLICE):
                texts = [t or "" for t in batch.column(at).slice(begin, end - begin).to_pylist()]
                ids, begins, ends = zip(*known.encode(texts, add_end))
                lists = [_lists(ids, pa.int32()), _lists(begins, pa.int64()), _lists(ends, pa.int64())]
                if back:
                    lists.append(pa.array([known.whole.decode(x.tolist()) if len(x) else "" for x in ids], pa.string()))
                made = pa.StructArray.from_arrays(lists, names=result.names)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(begin, end - begin) for k in kept], made], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema), name


def decoded(ids: Column, model: bytes) -> Column:
    """The text of an array of ids."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        known = pieces(model).whole
        return pd.Series([known.decode(x.tolist()) if x is not None and len(x) else "" for x in rows], dtype=object)

    return run(ids)


def model_bytes(path: str | None = None) -> bytes:
    """A model's file; without a path, that of the public 32,000 pieces with byte fallback."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def op13_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes()
    done, name = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, back=True)
    ids, begins, ends = (F.col(f"{name}.{c}") for c in ("ids", "begins", "ends"))
    return done.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(f"{name}.back").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.array_join(F.concat(begins, F.slice(ends, -1, 1)).cast("array<string>"), " ").cast("binary"), 256).alias("spans_sha256"),
    )
