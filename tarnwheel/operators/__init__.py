"""Relational operators with the naming, null and tie rules of the query catalogue."""

from .aggregates import arg_first, pivot_sorted, share_of_rows
from .joins import anti_join, join_suffix
from .pairs import top_pairs
from .topk import top_k
from .windows import (
    dense_rank_desc,
    group_totals,
    growth_pct,
    ordinal_rank,
    previous_value,
    rolling_mean,
    running_count,
    running_sum,
)

__all__ = [
    "anti_join",
    "arg_first",
    "dense_rank_desc",
    "group_totals",
    "growth_pct",
    "join_suffix",
    "ordinal_rank",
    "pivot_sorted",
    "previous_value",
    "rolling_mean",
    "running_count",
    "running_sum",
    "share_of_rows",
    "top_k",
    "top_pairs",
]
