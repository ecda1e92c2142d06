"""Top-k with a mandatory tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, by: str | Column, *tie_break: str | Column) -> DataFrame:
    """The k rows with the greatest ``by``; ties go to the smallest ``tie_break``.

    Planned as ``TakeOrderedAndProject``: every task keeps k rows only.
    """
    if not tie_break:
        raise ValueError("top_k needs a tie-break, otherwise its result is not defined")
    first = F.col(by) if isinstance(by, str) else by
    return df.orderBy(first.desc_nulls_last(), *tie_break).limit(k)
