"""Fingerprints of query results, and the comparison of two of them.

A fingerprint does not depend on the order of the rows: every row is turned into
text and hashed, and the hashes are added up.  That is a partial aggregate, so a
result of any size is fingerprinted without sorting it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.functions import digest16, last_json_line

#: Hash buckets in which two results are compared before their rows are.
LEAVES = 65_536

PAYLOAD = T.StructType(
    [
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField(
            "shape",
            T.StructType([T.StructField("rows", T.LongType()), T.StructField("cols", T.LongType())]),
        ),
        T.StructField("hash", T.StringType()),
    ]
)


def require_table(result: object) -> DataFrame:
    if not isinstance(result, DataFrame):
        raise TypeError(f"a result must be a DataFrame, not {type(result).__name__}")
    return result


def _cell(field: T.StructField, name: str | None = None) -> Column:
    cell = F.col(f"`{name or field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        cell = cell + F.lit(0.0)  # -0.0 and 0.0 are one value
    return cell


def json_row(names: Sequence[str], fields: Sequence[T.StructField]) -> Column:
    """A JSON object of the columns ``names`` under the names of ``fields``; nulls are spelled out, so they differ from gaps."""
    cells = [_cell(f, n).alias(f"{i}_{f.name}") for i, (n, f) in enumerate(zip(names, fields, strict=True))]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One JSON object per row."""
    chosen = [f for f in df.schema if columns is None or f.name in columns]
    return json_row([f.name for f in chosen], chosen)


def row_number_of(text: Column) -> Column:
    """The first 60 bits of the SHA-256 of a text, a form that other engines have too."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def _digest(columns: Sequence[str], rows: Column, text: Column) -> Column:
    """Order-free hash of texts: their number and the sum of their row hashes."""
    total = F.coalesce(F.sum(row_number_of(text)).cast("string"), F.lit(""))
    return digest16(F.concat_ws("|", F.lit(",".join(columns)), rows.cast("string"), total))


def fingerprint(result: DataFrame) -> DataFrame:
    """One row: columns, shape and hash of a result."""
    df = require_table(result)
    rows = F.count(F.lit(1))
    return df.select(row_text(df).alias("__row")).agg(
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("columns"),
        F.struct(rows.alias("rows"), F.lit(len(df.columns)).cast("long").alias("cols")).alias("shape"),
        _digest(df.columns, rows, F.col("__row")).alias("hash"),
    )


def fingerprint_by(results: DataFrame, key: str) -> DataFrame:
    """One fingerprint per value of ``key`` of a table that holds many results."""
    columns = [c for c in results.columns if c != key]
    rows = F.count(F.lit(1))
    return (
        results.select(key, row_text(results, columns).alias("__row"))
        .groupBy(key)
        .agg(
            F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("columns"),
            F.struct(rows.alias("rows"), F.lit(len(columns)).cast("long").alias("cols")).alias("shape"),
            _digest(columns, rows, F.col("__row")).alias("hash"),
        )
    )


def fingerprint_all(results: Mapping[str, object]) -> DataFrame:
    """Runs of named results, one row each; a result that is no table is a failed run."""
    rows = []
    for name, result in results.items():
        try:
            payload, ok = fingerprint(require_table(result)), True
        except TypeError:
            payload, ok = SparkSession.active().createDataFrame([(None, None, None)], PAYLOAD), False
        rows.append(payload.select(F.lit(name).alias("question_id"), F.lit(ok).alias("ok"), *PAYLOAD.names))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def csv_lines(result: DataFrame) -> DataFrame:
    """One CSV text per row, columns in order."""
    return require_table(result).select(F.to_csv(F.struct(*[_cell(f) for f in result.schema])).alias("line"))


def parse_payloads(runs: DataFrame) -> DataFrame:
    """Read ``{columns, shape, hash}`` from the last line a run has printed."""
    payload = last_json_line("stdout", PAYLOAD)
    return runs.withColumn("__p", payload).select(
        "question_id",
        "ok",
        F.col("__p.columns").alias("columns"),
        F.col("__p.shape").alias("shape"),
        F.col("__p.hash").alias("hash"),
    )


def compare_runs(candidate: DataFrame, gold: DataFrame) -> DataFrame:
    """Compare two tables ``question_id, ok, columns, shape, hash``.

    ``exact_match`` is three-valued: false if the candidate failed or a payload
    is unreadable, null if only the gold run failed.
    """
    theirs = candidate.select(
        "question_id",
        F.col("ok").alias("generated_ok"),
        F.col("hash").alias("generated_hash"),
        F.col("shape").alias("generated_shape"),
        F.col("columns").alias("generated_columns"),
    )
    ours = gold.select(
        F.col("question_id").alias("__gold_id"),
        F.col("ok").alias("gold_ok"),
        F.col("hash").alias("gold_hash"),
        F.col("shape").alias("gold_shape"),
        F.col("columns").alias("gold_columns"),
    )
    readable = F.col("generated_hash").isNotNull() & F.col("gold_hash").isNotNull()
    both_ran = F.coalesce(F.col("generated_ok"), F.lit(False)) & F.coalesce(F.col("gold_ok"), F.lit(False))
    equal = (
        F.col("generated_hash").eqNullSafe(F.col("gold_hash"))
        & F.col("generated_shape").eqNullSafe(F.col("gold_shape"))
        & F.col("generated_columns").eqNullSafe(F.col("gold_columns"))
    )
    match = (
        F.when(~F.coalesce(F.col("generated_ok"), F.lit(False)), F.lit(False))
        .when(~F.coalesce(F.col("gold_ok"), F.lit(False)), F.lit(None).cast("boolean"))
        .when(~readable, F.lit(False))
        .otherwise(equal)
    )
    success = both_ran & readable
    shown = ["generated_hash", "gold_hash", "generated_shape", "gold_shape", "generated_columns", "gold_columns"]
    return theirs.join(ours, F.col("question_id") == F.col("__gold_id"), "left").select(
        "question_id",
        success.alias("success"),
        match.alias("exact_match"),
        *[F.when(success, F.col(c)).alias(c) for c in shown],
    )


def outcome(success: Column, exact_match: Column) -> Column:
    """OK, WRONG or FAIL."""
    return (
        F.when(success & F.coalesce(exact_match, F.lit(False)), F.lit("OK"))
        .when(success, F.lit("WRONG"))
        .otherwise(F.lit("FAIL"))
    )


def row_differences(candidate: DataFrame, gold: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """Rows that only one side has, duplicates counted, with ``side``: ``missing`` or ``extra``.

    Rows fall by hash into ``leaves``, whose signed sums (rows and two hashes) are
    combined map-side: all that is shuffled of leaves that agree.  Only rows of leaves
    that differ are shuffled and counted; both sides are read once more for
    that, so they have to give the same rows twice.  Different leaves have equal sums with a probability of 2 ** -128.

    Columns go by name and have to be on both sides; others of ``candidate`` are not compared.  Nulls are equal to nulls.
    """
    names = [f"c{i}" for i in range(len(gold.columns))]
    ours = gold.toDF(*names).withColumn("__n", F.lit(1))
    theirs = candidate.select(*[f"`{c}`" for c in gold.columns]).toDF(*names).withColumn("__n", F.lit(-1))
    first, second = F.xxhash64(*names), F.xxhash64(F.lit("second"), *names)
    signed = ours.union(theirs).withColumn("__leaf", F.pmod(first, F.lit(leaves)))

    def total(value: Column) -> Column:
        return F.sum(value.cast("decimal(20,0)") * F.col("__n"))

    differing = signed.groupBy("__leaf").agg(
        F.sum("__n").alias("__rows"), total(first).alias("__first"), total(second).alias("__second")
    )
    differing = differing.where((F.col("__rows") != 0) | (F.col("__first") != 0) | (F.col("__second") != 0))
    rows = signed.join(F.broadcast(differing.select("__leaf")), "__leaf", "left_semi")  # at most ``leaves`` numbers
    surplus = rows.groupBy(*names).agg(F.sum("__n").alias("__n")).where(F.col("__n") != 0)
    side = F.when(F.col("__n") > 0, F.lit("missing")).otherwise(F.lit("extra"))
    copies = F.explode(F.array_repeat(F.lit(0), F.abs("__n").cast("int")))
    return surplus.select(*names, side.alias("side"), copies.alias("__copy")).drop("__copy").toDF(*gold.columns, "side")
