"""Running sums over a whole table in the order of a column, without bringing all rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.session import written


def running_sums(values: DataFrame, order: str, sums: Sequence[str]) -> DataFrame:
    """values with `<name>_upto`, the sum of each of `sums` up to and with the row; order is distinct and not null.

    Rows are dealt by ranges of the order and summed within them; only the ranges' totals, one row for each partition, meet in one task.
    """
    dealt = written(values.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(F.broadcast(offsets), "_range")
    return summed.select(*values.columns, *[(F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"{c}_upto") for c in sums])
