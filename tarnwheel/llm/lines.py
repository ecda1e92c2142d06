"""Line dedup: repeated runs of lines by prefix doubling over line ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.session import reliable

from .textpass import map_texts, stored

#: Lines of the shortest run that counts as a repeat.
MIN_LINES = 2


def line_table(docs: DataFrame) -> DataFrame:
    """``row, doc, line, name``: every line of the documents, named by its content."""
    lines = docs.select("row", "doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    return lines.select("row", "doc", "line", F.unhex(F.md5(F.col("content").cast("binary"))).alias("name"))


def repeated(suffixes: DataFrame, names: list[str]) -> DataFrame:
    """The suffixes that share ``names`` with another one; ``name`` becomes the place of the first of them.

    One count per name, combined in the map tasks, is joined back.  It is written
    before, because AQE splits a skewed key only if both sides of a join are
    plain shuffles; so a name that a third of all lines carry is split.
    """
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "row", "line")
    classes = reliable(
        suffixes.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .drop("n")
    )
    return suffixes.join(classes, names).select("row", "doc", "line", F.col("first").alias("name"))


def later(at: Column) -> Column:
    """Whether a suffix is not the first of its class."""
    return (F.col("row") != at["row"]) | (F.col("line") != at["line"])


def longer(suffixes: DataFrame, by: int) -> DataFrame:
    """Pair the class of every suffix with that of the suffix ``by`` lines further down."""
    tails = suffixes.select("row", (F.col("line") - by).alias("line"), F.col("name").alias("tail"))
    return suffixes.join(tails, ["row", "line"])


def repeated_runs(lines: DataFrame, min_lines: int) -> DataFrame:
    """The suffixes of the line-id sequences whose first ``min_lines`` lines also start another suffix.

    Prefix doubling: classes of h lines and the classes h lines further down
    give those of 2h lines; the last step overlaps to reach ``min_lines``.
    A class is an interval of the suffix array with that much common prefix; its
    rank is the place of its first suffix, so no global sort is needed.  A
    suffix alone in its class is unique at any greater length and leaves.
    """
    found = reliable(repeated(lines, ["name"]))
    length = 1
    while length < min_lines:
        by = min(length, min_lines - length)
        found = reliable(repeated(longer(found, by), ["name", "tail"]))
        length += by
    return found


KEPT = T.StructType(
    [
        T.StructField("kept", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_runs", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def without_lines(min_lines: int):
    def cut(text: bytes | None, starts: list[int] | None) -> tuple:
        if text is None:
            return None, 0, 0, 0, hashlib.sha256(b"").hexdigest()
        lines = text.split(b"\n")
        kept, at, runs = [], 0, 0
        for start in sorted(starts or ()):
            if start > at or not runs:
                kept += lines[at:start]
                runs += 1
            at = max(at, start + min_lines)
        kept += lines[at:]
        out = b"\n".join(kept)
        removed = len(lines) - len(kept)
        return out.decode("utf-8", "replace"), len(lines), removed, runs, hashlib.sha256(out).hexdigest()

    return cut


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES
) -> DataFrame:
    """``doc_id, kept, n_lines, n_removed, n_runs, kept_sha256`` of every row.

    Every run of ``min_lines`` or more lines that also starts earlier (smaller
    id, null last; same document, earlier line) is a later copy and goes; what
    overlaps or touches is one run.  Runs never cross documents, and are judged
    on the input, not on what is left.  Lines end at ``\\n`` and are compared as
    they are, empty ones included.

    A null text has no lines and stays null; an empty text has one empty line.
    Of equal rows, and of rows with one id, one is first, and which one is
    arbitrary but fixed during the run.
    """
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc"),
            F.col(text_col).cast("string").alias("text"),
        ),
        "lines",
    )
    copies = repeated_runs(line_table(rows), min_lines).where(later(F.col("name")))
    starts = copies.groupBy("row").agg(F.collect_list("line").alias("starts"))
    return map_texts(
        rows.join(starts, "row", "left"),
        {"doc_id": "doc"},
        "text",
        lambda: without_lines(min_lines),
        KEPT,
        ("starts",),
    )
