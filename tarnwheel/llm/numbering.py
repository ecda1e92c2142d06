"""Gapless numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int = 256) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within ``keys``, in a fixed pseudo-random order.

    Rows of a key are dealt to ``buckets`` by a hash of ``order``.  Counts per
    bucket, which are combined in the map tasks, give the first number of each,
    and only the rows of one bucket are sorted together.  Rows that are equal in
    ``order`` share a bucket and get neighbouring numbers.
    """
    cell = [*keys, "__bucket"]
    dealt = df.withColumn("__hash", F.xxhash64(*order)).withColumn("__bucket", F.pmod("__hash", F.lit(buckets)))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    within = Window.partitionBy(*cell).orderBy("__hash", *order)
    return (
        dealt.join(starts, cell)
        .withColumn(name, F.col("__start") + F.row_number().over(within) - 1)
        .drop("__hash", "__bucket", "__start")
    )
