"""From raw documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. What a stage defines for nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns is what its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm import decontamination, pii_surrogates, quality_fm, simhash_dedup, source_mixing
from relata.llm.frames import fresh, table
from relata.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at the threshold or above."""
    return quality_fm.keep_good(docs, quality_fm.fitted(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    return simhash_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of a benchmark item occurs in."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return pii_surrogates.rewrite(docs, pii_surrogates.key_of(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their words, their source's words and target, and the words taken of them."""
    names = [fresh(docs, n) for n in ("size", "source_size", "target", "taken")]
    sized = docs.withColumn(names[0], source_mixing.word_count(F.col("text")))
    return source_mixing.mix(sized, names[0], names=tuple(names[1:])).where(F.col(names[3]) > 0)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII surrogates", personal_data),
    ("source mixing", mixing),
]

#: SQL can express neither the fitted classifier nor XXH64 fingerprints; tests compare with a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage{number}")
    return docs
