"""Date and time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import ColumnOrName, _col


def iso_date(c: ColumnOrName) -> Column:
    """``yyyy-MM-dd`` text of a date, a timestamp or a text that starts with one."""
    return F.to_date(_col(c)).cast("string")


def iso_month(c: ColumnOrName) -> Column:
    return F.substring(iso_date(c), 1, 7)


def iso_year(c: ColumnOrName) -> Column:
    return F.substring(iso_date(c), 1, 4)


def iso_dates(df: DataFrame) -> DataFrame:
    """Turn every timestamp column into ISO date text, in place."""
    stamps = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    return df.withColumns({name: iso_date(name) for name in stamps}) if stamps else df


def ntz(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def in_year(c: ColumnOrName, year: int) -> Column:
    """Half-open range on a timestamp column: unlike a text prefix it reaches the scan."""
    return (_col(c) >= ntz(f"{year}-01-01")) & (_col(c) < ntz(f"{year + 1}-01-01"))


def to_datetime(c: ColumnOrName) -> Column:
    """A text ``yyyy-MM-dd[ HH:mm:ss[.ffffff]]`` as an instant without a zone; null if it is none."""
    return _col(c).try_cast("timestamp_ntz")


def day_gap(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Days between two dates."""
    return F.datediff(_col(later), _col(earlier)).cast("long")


def whole_days(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Whole 24-hour days between two instants, truncated toward zero.

    Calendar-day difference would count one day for two hours over midnight.
    """
    span = _col(later).cast("timestamp_ntz") - _col(earlier).cast("timestamp_ntz")
    return F.extract(F.lit("DAY"), span).cast("long")
