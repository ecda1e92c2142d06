"""Comparison of a Spark result with the SQL twin on DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

DATA = Path(os.environ.get("TARNWHEEL_TESTDATA", "/root/testdata"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(folder: Path | str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA:
        return "null"
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "tolist"):
        return cell(value.tolist())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(dtype.kind, "text")


def canonical(frame: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    columns = sorted(frame.columns)
    data = [[cell(v) for v in frame[c].tolist()] for c in columns]
    return columns, sorted(zip(*data, strict=True)) if columns else []


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None if both frames hold the same rows, otherwise what differs."""
    lc, lr = canonical(left)
    rc, rr = canonical(right)
    if lc != rc:
        return f"columns {lc} != {rc}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} != {len(rr)}"
    for a, b in zip(lr, rr, strict=True):
        if a != b:
            extra = len(set(lr) - set(rr))
            return f"{extra} rows differ, first {dict(zip(lc, a))} != {dict(zip(rc, b))}"
    types = {c: (kind(left[c].dtype), kind(right[c].dtype)) for c in lc}
    wrong = {c: t for c, t in types.items() if t[0] != t[1] and len(lr)}
    return f"types {wrong}" if wrong else None


def fetched(df) -> pd.DataFrame:
    """The rows of a Spark result; whole numbers stay whole beside nulls."""
    frame = df.toPandas()
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType) and frame[f.name].dtype.kind == "f"]
    return frame.astype(dict.fromkeys(whole, "Int64"))


def check(spark, folder, names=None):
    """Run queries against their twins; yields (name, seconds, problem, rows)."""
    import __spark_entry__ as entry

    queries, twins = entry.queries(), entry.oracle_sql()
    connection = duck(folder)
    for name in names or queries:
        started = time.time()
        try:
            got = fetched(queries[name](spark, str(folder)))
            problem = None
            if name in twins:
                problem = difference(got, connection.execute(twins[name]).df())
        except Exception as error:  # reported as the problem of this query
            problem, got = f"{type(error).__name__}: {str(error)[:1500]}", pd.DataFrame()
        yield name, time.time() - started, problem, len(got)


if __name__ == "__main__":
    from tarnwheel.session import build_session

    scale, *prefixes = sys.argv[1:] or ["sf0.01"]
    extra = dict(a.split("=", 1) for a in prefixes if "=" in a)
    prefixes = [p for p in prefixes if "=" not in p]
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    if "plain" in prefixes:  # a session that knows nothing of this package
        prefixes.remove("plain")
        builder = SparkSession.builder.master("local[8]")
        for key, value in {**quiet, **extra}.items():
            builder = builder.config(key, value)
        spark = builder.getOrCreate()
    else:
        spark = build_session(master="local[8]", settings={**quiet, **extra})
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    chosen = [n for n in entry.queries() if not prefixes or any(n.startswith(p) for p in prefixes)]
    bad = 0
    for name, seconds, problem, rows in check(spark, DATA / scale, chosen):
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:45s} {seconds:6.2f}s {rows:8d} {problem or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} ok")
    spark.stop()
