"""Which answer of a question counts: first, last, or of the latest attempt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import group_totals


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], largest: bool) -> DataFrame:
    """Row number 1 per key.

    Spark limits every key to one row per task before the shuffle, so copies of
    one row, however many, do not meet in one task.
    """
    by = [F.col(c).desc() if largest else F.col(c) for c in order]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("__nth", number).where(F.col("__nth") == 1).drop("__nth")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the earliest row per key; the order must be unique inside a key."""
    return _one_per_key(df, keys, order, largest=False)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the latest row per key."""
    return _one_per_key(df, keys, order, largest=True)


def latest_attempt(df: DataFrame, key: str, attempt: str = "attempt") -> DataFrame:
    """Drop the partial results of earlier attempts of a submission."""
    held = group_totals(df, [key], __latest=F.max(attempt))
    return held.where(F.col(attempt) == F.col("__latest")).drop("__latest")


def status_of(done: Column, failed: Column) -> Column:
    """Status of a submission from the order of its last ``done`` and its last ``error`` record."""
    return (
        F.when(done.isNull() & failed.isNull(), F.lit("running"))
        .when(failed.isNull() | (done > failed), F.lit("done"))
        .otherwise(F.lit("failed"))
    )


def status_aggregates(kind: Column, order: Column, message: Column) -> tuple[Column, Column]:
    """Aggregates for the status of a submission and its error text.

    Only ``done`` and ``error`` records decide, the later of them; any other
    record leaves the submission as it is, before, between and after them.
    """
    done = F.max(F.when(kind == "done", order))
    failed = F.max(F.when(kind == "error", order))
    status = status_of(done, failed)
    text = F.substring(F.coalesce(message, F.lit("Backend error")), 1, 2000)
    last = F.max_by(text, F.when(kind == "error", order))
    return status, F.when(status == "failed", last)
