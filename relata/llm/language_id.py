"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter's vector is rotated by its
place in a trigram, the three are bound by multiplication, and a text is the
bundle, the sum, of its trigrams' vectors. A language's prototype is the bundle
of its learned texts, each scaled to length one. A text gets the language whose
prototype has the largest cosine with it.

Letter vectors are drawn from a generator seeded by the letter, so every worker
makes the same ones without a table to share. Prediction is one map over whole
texts, in pieces of bounded length. Prototypes are fitted on at most about
`per_language` texts of each language, taken by a hash of id and text; counts of the
languages, which set the taken fraction, are over all learnable rows.

Defined results: a null text, or one without a letter, is `und` with score 0;
so is any text if no language was learned; a null lang or id is never learned
from; equal cosines go to the lesser language in code-point order; repeated rows
each get their row; a very long text is bundled in pieces; extra columns are carried and not read,
and one named like a result is an error, as the result would be there twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.frames import remainder, table

DIMENSIONS = 512
ORDER = 3
SEED = 1109
PER_LANGUAGE = 4000
#: Languages that are learned, those with the most rows; the prototypes are held in memory.
MAX_LANGUAGES = 2000
PIECE = 1 << 20
_SHIFT = 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 where it is none."""
    out = np.zeros(0x110000, np.uint32)
    for k in range(len(out)):
        c = chr(k)
        if c.isalpha():
            out[k] = ord(c.lower()[0])
    return out


class Alphabet:
    """Vectors of the letters met so far, one table for each place in an n-gram."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.row = np.full(0x110000, -1, np.int32)
        self.places = [np.zeros((0, dimensions), np.int8)] * ORDER

    def rows(self, symbols: np.ndarray) -> np.ndarray:
        new = np.unique(symbols[self.row[symbols] < 0])
        if len(new):
            drawn = np.stack([np.random.Generator(np.random.PCG64([self.seed, int(x)])).integers(0, 2, self.dimensions, np.int8) * 2 - 1 for x in new]).astype(np.int8)
            self.row[new] = np.arange(len(new)) + len(self.places[0])
            self.places = [np.concatenate([old, np.roll(drawn, ORDER - 1 - k, axis=1)]) for k, old in enumerate(self.places)]
        return self.row[symbols]


@lru_cache(maxsize=2)
def alphabet(dimensions: int, seed: int) -> Alphabet:
    return Alphabet(dimensions, seed)


def bundle(text: str, known: Alphabet) -> np.ndarray | None:
    """The sum of the vectors of a text's trigrams over letters and single gaps; None without a letter."""
    table_of, total, tail, seen = letters(), np.zeros(known.dimensions, np.float64), np.zeros(1, np.uint32), False
    for k in range(0, max(len(text), 1), PIECE):
        points = np.frombuffer(text[k : k + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.concatenate([tail, table_of[points], np.zeros(int(k + PIECE >= len(text)), np.uint32)])
        symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
        seen = seen or bool((symbols != 0).any())
        if len(symbols) >= ORDER:
            rows = known.rows(symbols).astype(np.int64)
            grams, counts = np.unique(rows[:-2] << (2 * _SHIFT) | rows[1:-1] << _SHIFT | rows[2:], return_counts=True)
            low = (1 << _SHIFT) - 1
            for b in range(0, len(grams), 8192):
                g = grams[b : b + 8192]
                bound = known.places[0][g >> (2 * _SHIFT)] * known.places[1][g >> _SHIFT & low]
                bound *= known.places[2][g & low]
                total += counts[b : b + 8192].astype(np.float32) @ bound.astype(np.float32)
        tail = symbols[-2:]
    return total if seen else None


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def learn(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """A prototype for each language among the usable rows."""
    rows = docs.where(usable).select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("i is not null and lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    parts = 1 << 20
    take = F.greatest(F.lit(1), F.floor(F.lit(parts * per_language) / F.col("n")))
    picked = rows.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("i", "text", F.lit(seed)), F.lit(parts)) < take).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = alphabet(dimensions, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = bundle(text.as_py(), known)
                if v is not None:
                    found[lang] = found.get(lang, 0) + np.round(_unit(v) * (1 << 30)).astype(np.int64)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["lang", "sum"])

    def total(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.int64) for x in group.column("sum").to_pylist()]
        return pa.table({"lang": group.column("lang").slice(0, 1), "sum": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

    made = picked.mapInArrow(sums, "lang string, sum binary").groupBy("lang").applyInArrow(total, "lang string, sum binary").collect()
    return {r["lang"]: _unit(np.frombuffer(r["sum"], np.int64).astype(np.float64)) for r in sorted(made, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """docs without the text, with lang_pred and score, the cosine brought to 0..1."""
    clash = {"lang_pred", "score"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename {sorted(clash)} first: the results have these names")
    names = sorted(prototypes, key=lambda s: s.encode())
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, dimensions))
    at = docs.columns.index(text_col)
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.limit(0).select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = alphabet(dimensions, seed)
        for batch in batches:
            langs, scores = [], []
            for value in batch.column(at):
                v = bundle(value.as_py() or "", known) if names else None
                if v is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cosines = np.round(matrix @ _unit(v), 12)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, (1 + cosines[best]) / 2))))
            columns = [batch.column(k) for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 4)
    prototypes = learn(docs, fold != 2)
    return predict(docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"), prototypes)
