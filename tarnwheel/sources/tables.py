"""Table scans by format, and registries of named tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_FORMAT = "parquet"


def resolve(path: str, root: str | None = None) -> str:
    """A path below ``root``; absolute paths and URIs are kept."""
    if root is None or "://" in path or PurePosixPath(path).is_absolute():
        return path
    return f"{root.rstrip('/')}/{path}"


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    *,
    schema: T.StructType | None = None,
    root: str | None = None,
) -> DataFrame:
    """Scan one table; Parquet unless told otherwise, CSV with a header line."""
    fmt = fmt or DEFAULT_FORMAT
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
        reader = reader.option("inferSchema", True) if schema is None else reader
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(resolve(path, root))


class Tables:
    """The driver tables of one folder: ``t.lineitem`` is a lazy scan of that file."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, f"{name}.parquet", root=self.folder)

    @cached_property
    def path(self) -> str:
        return self.folder


def open_registry(
    spark: SparkSession,
    datasets: Mapping[str, Mapping[str, str]],
    *,
    root: str | None = None,
    schemas: Mapping[str, T.StructType] | None = None,
    views: bool = True,
) -> dict[str, DataFrame]:
    """Open ``{name: {file_name, format}}`` and bind every name to a temp view."""
    tables = {
        name: read_table(
            spark,
            entry["file_name"],
            entry.get("format"),
            schema=(schemas or {}).get(name),
            root=root,
        )
        for name, entry in datasets.items()
    }
    if views:
        for name, table in tables.items():
            table.createOrReplaceTempView(name)
    return tables


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose Parquet scans answer counts from the footers of the files."""
    own = spark.newSession()
    kept = [s for s in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if s.strip() != "parquet"]
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(kept))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def table_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table, and a last row with the totals of the same counts.

    Tables that a ``footer_session`` has opened are not scanned; others are read once.
    """
    counted = None
    for name in sorted(tables):
        table = tables[name]
        one = table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(table.columns)).cast("long").alias("column_count"),
            F.lit(1).cast("long").alias("table_count"),
        )
        counted = one if counted is None else counted.unionByName(one)
    return counted.rollup("table_name").agg(
        *[F.sum(c).alias(c) for c in ("row_count", "column_count", "table_count")]
    ).withColumn("table_name", F.coalesce("table_name", F.lit("TOTAL")))
