"""Physical plans: what is pushed down, broadcast, and kept out of single tasks."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from support import DATA
from tarnwheel.plans.registry import CATALOGUE

FOLDER = str(DATA / "sf0.001")


def plan_of(spark, name: str) -> str:
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", [n for n in CATALOGUE if n.startswith(("agg", "fil", "joi", "win", "pip", "opt"))]
)
def test_no_python_no_cross_join(spark, name):
    plan = plan_of(spark, name)
    assert "Python" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("fil11_forecast_revenue_lines", "l_shipdate"),
        ("fil15_large_orders_of_1997", "o_orderdate"),
        ("opt20_spending_per_nation_of_1998", "o_orderdate"),
        ("opt16_revenue_of_small_parts_per_brand", "p_size"),
        ("opt12_revenue_per_nation_of_finished_orders", "o_orderstatus"),
    ],
)
def test_filters_reach_the_scan(spark, name, column):
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(spark, name))
    assert any(re.search(rf"(Than|EqualTo|ThanOrEqual)\({column},", p) for p in pushed), pushed


def test_scans_read_only_needed_columns(spark):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan_of(spark, "opt14_revenue_per_nation"))
    lines = next(s for s in schemas if "l_orderkey" in s)
    assert {c.split(":")[0] for c in lines.split(",")} == {"l_orderkey", "l_extendedprice", "l_discount"}


@pytest.mark.parametrize(
    "name", [n for n in entry.queries() if n.startswith(("win", "opt21", "l01", "pip05", "v06", "x08"))]
)
def test_windows_are_partitioned(spark, name):
    """What goes to one task is counts and samples of tasks, never rows."""
    lines = plan_of(spark, name).splitlines()
    below = [child for line, child in zip(lines, lines[1:]) if "SinglePartition" in line]
    assert all("functions=[partial_" in child for child in below), below
    assert below or name.startswith(("win05", "win08", "win09", "win12", "win13"))  # those need no scan


def test_top_k_is_taken_per_task(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "opt28_best_customers_of_1998")


def test_first_row_per_key_is_limited_before_the_shuffle(spark):
    plan = plan_of(spark, "x04_first_answer_wins")
    assert plan.count("WindowGroupLimit") == 2


def test_measures_are_summed_before_the_shuffle(spark):
    plan = plan_of(spark, "pip02_revenue_per_european_nation")
    first_scan = plan[: plan.index("l_extendedprice") if "l_extendedprice" in plan else None]
    assert "partial_sum" in plan and "Aggregate" in first_scan
