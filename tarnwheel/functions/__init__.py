"""Scalar and aggregate expressions built on the Spark function library."""

from .numeric import (
    amount,
    clamp,
    mean_dp,
    money,
    n_unique,
    power_floor,
    ratio,
    revenue,
    round_dp,
    sum_dp,
    sum_or_zero,
    units,
)
from .temporal import day_gap, in_year, iso_date, iso_dates, iso_month, iso_year, ntz, to_datetime, whole_days
from .text import digest16, last_json_line, slug

__all__ = [
    "amount",
    "clamp",
    "day_gap",
    "digest16",
    "in_year",
    "iso_date",
    "iso_dates",
    "iso_month",
    "iso_year",
    "last_json_line",
    "mean_dp",
    "money",
    "n_unique",
    "ntz",
    "power_floor",
    "ratio",
    "revenue",
    "round_dp",
    "slug",
    "sum_dp",
    "sum_or_zero",
    "to_datetime",
    "units",
    "whole_days",
]
