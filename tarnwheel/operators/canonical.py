"""The canonical order of a result (all columns, left to right) and a digest of the rows in it.

Neither puts the rows into one task.  The digest of a sequence is a polynomial
over its items, so that of two parts one after the other follows from theirs:
``digest(A + B) = digest(A) + r ** len(A) * digest(B)`` modulo a prime.  Each task
of a range sort makes the digest of its own rows, and one row per task is merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.functions import digest16

from .fingerprint import json_row, require_table, row_number_of
from .windows import running_sum

#: (prime, base) of the two polynomials; products of two remainders stay below 2 ** 63.
MODULI = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))
#: Bits of the row number in ``monotonically_increasing_id``; those above are the task.
ROW_BITS = 33
#: Bits of an exponent that one lookup handles.
DIGIT = 6
#: Copies of one row that are numbered by one task.
COPIES = 65_536


def power(base: int, prime: int, exponent: str, bits: int) -> str:
    """SQL for ``base ** exponent`` modulo ``prime``, for an exponent of at most ``bits`` bits, by digits of ``DIGIT`` bits.

    The powers of a digit are one text that Spark folds to an array, and the whole is
    text, which is parsed at once: faster to build than hundreds of columns.
    """
    out = "1L"
    for shift in range(0, bits, DIGIT):
        powers = ",".join(str(pow(base, digit << shift, prime)) for digit in range(1 << DIGIT))
        digit = f"cast(shiftright({exponent}, {shift}) & {(1 << DIGIT) - 1} as int)"
        out = f"({out} * get(cast(split('{powers}', ',') as array<bigint>), {digit}) % {prime}L)"
    return out


def _runs(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Different rows with their number ``__n``, combined map-side, under names that cannot clash."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("__n")), names


def ordered_digest(result: DataFrame) -> DataFrame:
    """One row ``columns, shape, hash``: equal for two results exactly if their sorted rows are.

    The items are the different rows in canonical order, nulls first, each with its
    number of copies, so a row that fills a third of the table is one item.
    The hash depends on names, order and types of the columns as far as their text shows them.
    -0.0 is 0.0.  A table without rows has the hash of an empty sequence.  Columns of a
    type without an order (maps) raise Spark's error.
    """
    df = require_table(result)
    runs, names = _runs(df)
    text = F.concat(json_row(names, df.schema), F.lit("*"), F.col("__n").cast("string"))
    # The number of a row is taken after the sort, in the task that has sorted it.
    items = runs.orderBy(*names).select(
        F.monotonically_increasing_id().alias("__at"), row_number_of(text).cast("long").alias("__h"), "__n"
    )
    terms = [F.expr(f"__h % {p}L * {power(r, p, f'(__at & {(1 << ROW_BITS) - 1}L)', ROW_BITS)} % {p}L") for p, r in MODULI]
    parts = items.groupBy(F.shiftright("__at", ROW_BITS).alias("__task")).agg(
        F.count(F.lit(1)).alias("__items"),
        F.sum("__n").alias("__rows"),
        *[
            (F.sum(term.cast("decimal(20,0)")) % F.lit(p)).cast("long").alias(f"__d{i}")
            for i, ((p, _), term) in enumerate(zip(MODULI, terms, strict=True))
        ],
    )
    # One row per task of the sort from here on.
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("__before", F.coalesce(F.sum("__items").over(before), F.lit(0)))
    merged = [
        F.sum(F.expr(f"__d{i} * {power(r, p, '__before', 60)} % {p}L").cast("decimal(20,0)")) % F.lit(p)
        for i, (p, r) in enumerate(MODULI)
    ]
    rows = F.coalesce(F.sum("__rows"), F.lit(0))
    digests = [F.coalesce(m.cast("long"), F.lit(0)).cast("string") for m in merged]
    return placed.agg(
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("columns"),
        F.struct(rows.alias("rows"), F.lit(len(df.columns)).cast("long").alias("cols")).alias("shape"),
        digest16(F.concat_ws("|", F.lit(",".join(df.columns)), rows.cast("string"), *digests)).alias("hash"),
    )


def canonical_positions(result: DataFrame, name: str = "position") -> DataFrame:
    """Add ``name``: the place of a row, from 0, in the order of all columns, nulls first.

    The places are a prefix scan over the different rows and their numbers; the copies
    of one row are numbered in blocks by several tasks.  A table without rows stays so.
    """
    df = require_table(result)
    runs, names = _runs(df)
    placed = running_sum(runs, F.col("__n"), [], names, "__end")
    start = F.col("__end") - F.col("__n")
    last = F.col("__end") - 1
    blocks = placed.withColumn("__block", F.explode(F.sequence(start, last, F.lit(COPIES).cast("long"))))
    blocks = blocks.withColumn("__last", F.least(F.col("__block") + (COPIES - 1), last)).drop("__n", "__end")
    spread = blocks.repartition("__block")
    rows = spread.withColumn("__place", F.explode(F.sequence("__block", "__last")))
    return rows.select(*names, "__place").toDF(*df.columns, name)
