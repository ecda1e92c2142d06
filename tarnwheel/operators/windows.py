"""Windowed columns by prefix scans (see ``scan``): one plan for hot keys, no key at all, and small inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.functions import ratio, round_dp
from tarnwheel.session import reliable

from .scan import RANGE, TIE, ranged, same_keys

OFFSET = "__offset"


def _cumulative(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    total: Column,
    descending: bool = False,
) -> DataFrame:
    """Add ``name``: the running ``total``, an aggregate that adds up over parts."""
    cut = ranged(df, keys, order, descending=descending)
    frame = Window.partitionBy(*cut.partition).orderBy(*cut.by()).rowsBetween(Window.unboundedPreceding, 0)
    held = cut.with_offset(total, OFFSET).withColumn(name, total.over(frame) + F.col(OFFSET))
    return held.select(*df.columns, name)


def running_sum(
    df: DataFrame,
    value: Column,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
) -> DataFrame:
    """Sum of ``value`` from the first row of the key to this one (rows, not peers).

    Null stays null and does not end the sum.
    """
    held = df.withColumn("__value", value)
    total = F.sum(F.coalesce(F.col("__value"), F.lit(0)))
    summed = _cumulative(held, keys, order, name, total)
    return summed.withColumn(name, F.when(F.col("__value").isNotNull(), F.col(name))).drop("__value")


def running_count(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number of non-null ``value`` so far."""
    return _cumulative(df, keys, order, name, F.count(value))


def ordinal_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    descending: bool = False,
) -> DataFrame:
    """1, 2, 3 … in the given order; equal rows in the order of a hash of their columns."""
    return _cumulative(df, keys, order, name, F.count(F.lit(1)), descending)


def dense_rank_desc(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Dense rank, greatest first; a null value has a null rank.

    Earlier ranges of a key count their different values; one that goes on in
    the next range is the same value.
    """
    cut = ranged(df, keys, [value], descending=True)
    parts = (
        cut.of_cut_keys()
        .where(F.col(value).isNotNull())
        .groupBy(*cut.partition)
        .agg(F.countDistinct(value).alias("__n"), F.max(value).alias("__first"), F.min(value).alias("__last"))
    )
    goes_on = (F.lag("__last").over(cut.earlier()) == F.col("__first")).cast("int")
    parts = parts.withColumn("__same", F.coalesce(goes_on, F.lit(0)))
    before = cut.earlier().rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.sum(F.col("__n") - F.col("__same")).over(before), F.lit(0))
    held = cut.with_partials(parts.withColumn(OFFSET, new - F.col("__same")), OFFSET, 0)
    window = Window.partitionBy(*cut.partition).orderBy(F.col(value).desc_nulls_last())
    rank = F.dense_rank().over(window).cast("long") + F.col(OFFSET)
    return held.withColumn(name, F.when(F.col(value).isNotNull(), rank)).select(*df.columns, name)


def group_totals(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add aggregates of the whole key to each of its rows.

    The aggregates are combined map-side, one row per key, and joined back
    null-safely; a key with very many rows is a skewed join, which AQE splits.
    """
    keys = list(keys)
    totals = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    if not keys:
        return df.join(F.broadcast(totals))  # one row
    named = totals.select(*[F.col(k).alias(f"__t_{k}") for k in keys], *aggregates)
    return df.join(named, same_keys(keys, [f"__t_{k}" for k in keys])).select(*df.columns, *aggregates)


def _with_neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int, build: Callable
) -> DataFrame:
    """Apply ``build(window)`` where every row sees ``back`` rows before it.

    A range of a key that is cut gets copies of the last ``back`` rows before
    it: each range hands on its own last rows, and takes the last ones of what
    the ``back`` ranges before it hand on.
    """
    cut = ranged(df, keys, order)
    held = cut.rows.columns
    from_end = Window.partitionBy(*cut.partition).orderBy(*[F.col(c).desc() for c in (*order, TIE)])
    lasts = cut.of_cut_keys().withColumn("__from_end", F.row_number().over(from_end)).where(F.col("__from_end") <= back)
    row = F.struct(F.col("__from_end"), F.struct(*held).alias("row"))
    handed = lasts.groupBy(*cut.partition).agg(F.sort_array(F.collect_list(row), asc=False).alias("__rows"))
    before = cut.earlier().rowsBetween(-back, -1)
    handed = handed.withColumn("__rows", F.flatten(F.collect_list("__rows").over(before)))
    copies = handed.select(
        F.col(RANGE).alias("__to"),
        F.explode(F.slice("__rows", F.greatest(F.size("__rows") - back, F.lit(0)) + 1, F.lit(back))).alias("__row"),
    ).select("__row.row.*", "__to")
    copies = copies.withColumn(RANGE, F.col("__to")).drop("__to").withColumn("__copy", F.lit(True))
    added = build(Window.partitionBy(*cut.partition).orderBy(*cut.by()))
    return (
        cut.rows.withColumn("__copy", F.lit(False))
        .unionByName(copies)
        .withColumns(added)
        .where(~F.col("__copy"))
        .select(*df.columns, *added)
    )


def previous_value(
    df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """``value`` of the previous row of the key."""
    return _with_neighbours(df, keys, order, 1, lambda w: {name: F.lag(value, 1).over(w)})


def rolling_mean(
    df: DataFrame,
    value: Column,
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    name: str,
    total: Callable[[Column], Column] = lambda c: c,
) -> DataFrame:
    """Mean of the last ``size`` rows; null until there are that many non-null ones.

    ``total`` turns a sum of ``value`` into the number that is divided.
    """
    held = df.withColumn("__value", value)

    def build(window):
        frame = window.rowsBetween(1 - size, 0)
        mean = ratio(total(F.sum("__value").over(frame)), F.lit(size))
        return {name: F.when(F.count("__value").over(frame) == size, mean)}

    return _with_neighbours(held, keys, order, size - 1, build).drop("__value")


def growth_pct(df: DataFrame, value: str, order: str, name: str, places: int = 1) -> DataFrame:
    """Growth in percent over the previous row of a series, which is written once, as a scan reads it several times."""
    held = previous_value(reliable(df), value, [], [order], "__before")
    growth = ratio(F.col(value) - F.col("__before"), F.col("__before")) * 100
    return held.withColumn(name, round_dp(growth, places)).drop("__before")


__all__ = [
    "dense_rank_desc",
    "group_totals",
    "growth_pct",
    "ordinal_rank",
    "previous_value",
    "rolling_mean",
    "running_count",
    "running_sum",
]
