"""All queries on tables in which one key of every kind holds a third of the rows."""

from __future__ import annotations

import os
import shutil

import pytest

from support import DATA, TABLES, check, duck
from tarnwheel.plans.registry import CATALOGUE

HOT = {
    "lineitem": {"l_orderkey": 0, "l_partkey": 1, "l_suppkey": 2},
    "orders": {"o_custkey": 0},
    "customer": {"c_nationkey": 1},
    "supplier": {"s_nationkey": 2},
    "events": {"user_id": 0},
}
# The ones that split, pair up or join row by row; TARNWHEEL_FULL=1 takes them all.
CHOSEN = ("win", "pip01", "pip06", "pip11", "joi06", "joi07", "joi15", "opt17", "opt21", "o04", "s16", "v02_o", "v04", "v06", "v08", "x01", "x04", "x06", "x08")
FULL = os.environ.get("TARNWHEEL_FULL") == "1"
NAMES = [n for n in CATALOGUE if n.startswith("" if FULL else CHOSEN)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Copies of the smallest tables; every third row has key 0."""
    out = tmp_path_factory.mktemp("skewed")
    source = DATA / "sf0.001"
    connection = duck(source)
    for name in TABLES:
        if name in HOT:
            replaced = ", ".join(
                f"CASE WHEN n % 3 = {rest} THEN CAST(0 AS {'INTEGER' if 'nation' in key else 'BIGINT'}) ELSE {key} END AS {key}"
                for key, rest in HOT[name].items()
            )
            connection.execute(
                f"""COPY (SELECT * EXCLUDE (n) REPLACE ({replaced}) FROM
                    (SELECT *, row_number() OVER () AS n FROM {name})) TO '{out}/{name}.parquet' (FORMAT parquet)"""
            )
        elif (source / f"{name}.parquet").exists():
            shutil.copy(source / f"{name}.parquet", out / f"{name}.parquet")
    return out


@pytest.fixture(scope="module")
def session(spark):
    """Many ranges, so that the hot keys are cut; no broadcast by estimate."""
    changed = {
        "spark.sql.shuffle.partitions": "20",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", NAMES)
def test_skewed(session, folder, name):
    ((_, _, problem, _),) = check(session, folder, [name])
    assert problem is None
