"""Imports every module that registers queries."""

from . import aggregations, evaluation, filters, final, full, joins, streams, windows  # noqa: F401
from .catalogue import CATALOGUE

__all__ = ["CATALOGUE"]
