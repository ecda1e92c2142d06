"""Grouped operators beyond the plain aggregate functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.functions import ratio, round_dp


def arg_first(
    columns: Sequence[str | Column], order: Sequence[Column], *, largest: bool
) -> Column:
    """Struct of ``columns`` from the row with the greatest or least ``order``.

    An aggregate, so it is combined map-side; no group is sorted or collected.
    """
    picked, key = F.struct(*columns), F.struct(*order)
    return F.max_by(picked, key) if largest else F.min_by(picked, key)


def share_of_rows(grouped: DataFrame, count: str, source: DataFrame, places: int) -> Column:
    """Percentage of the rows of ``source``, whose size is one scalar subquery."""
    total = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    return round_dp(ratio(grouped[count], total) * 100, places)


def pivot_sorted(
    df: DataFrame,
    index: str,
    column: str,
    values: Sequence[str] | None,
    cell: Column,
    *,
    fill: float | None = None,
) -> DataFrame:
    """One row per ``index``, one column per value, in sorted order.

    With the values named by the caller the schema does not depend on the data
    and no extra job has to look for them.  With ``None`` Spark finds them, and
    refuses a column with more than ``spark.sql.pivotMaxValues`` of them.
    """
    wide = df.groupBy(index).pivot(column, None if values is None else sorted(values)).agg(cell)
    return wide if fill is None else wide.fillna(fill)
