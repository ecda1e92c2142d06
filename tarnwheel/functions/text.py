"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import ColumnOrName, _col

SLUG_LENGTH = 48
DIGEST_LENGTH = 16


def slug(c: ColumnOrName) -> Column:
    """Lower-case words of letters and digits joined by ``-``, 48 characters at most."""
    words = F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, SLUG_LENGTH)


def digest16(c: ColumnOrName) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(_col(c).cast("string"), 256), 1, DIGEST_LENGTH)


def last_json_line(c: ColumnOrName, schema: T.StructType | str) -> Column:
    """The last non-blank line of a text as JSON; null fields where it is not JSON."""
    text = F.rtrim(F.translate(_col(c), "\r", "\n"), F.lit(" \t\n\f"))
    return F.from_json(F.trim(F.substring_index(text, "\n", -1)), schema)
