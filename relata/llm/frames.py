"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys that may be broadcast as hot ones, at most.
HOT_KEYS = 20_000
HOT_ROWS = 1_000


def split_join(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with `keyed`, which has each key once and in `count` how many rows have it, without the count; both are written tables.

    Keys with more rows than HOT_ROWS and than a HOT_KEYS-th of all rows, so HOT_KEYS keys at most, come
    by broadcast and leave their rows where they are; no other key can fill a task. Keys of null are left out.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(HOT_ROWS, -(-total // HOT_KEYS))
    few = keyed.where(hot).drop(count)
    if few.isEmpty():
        return rows.join(keyed.drop(count), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(keyed.where(~hot).drop(count), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def per_batch(make) -> object:
    """A mapInArrow function from one that maps a record batch to another; empty batches pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run


def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
