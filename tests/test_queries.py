"""Every registered query against its SQL twin on DuckDB."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from support import DATA, check
from tarnwheel.plans.registry import CATALOGUE

FOLDER = DATA / os.environ.get("TARNWHEEL_SCALE", "sf0.001")
SPLIT = [n for n in entry.queries() if n.startswith(("win", "opt21", "v06", "x06", "x08", "l01"))]


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query(spark, name):
    ((_, _, problem, _),) = check(spark, FOLDER, [name])
    assert problem is None


@pytest.mark.parametrize("name", SPLIT)
def test_windows_with_split_keys(spark, split_small, name):
    ((_, _, problem, _),) = check(spark, DATA / "sf0.001", [name])
    assert problem is None


def test_every_query_has_a_twin():
    assert set(CATALOGUE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
