"""Structured Streaming jobs over event records."""

from .jobs import aggregate_stream, latest_rows, route_stream, stream_session
from .progress import final_rows, progress_records, statuses

__all__ = [
    "aggregate_stream",
    "final_rows",
    "latest_rows",
    "progress_records",
    "route_stream",
    "statuses",
    "stream_session",
]
