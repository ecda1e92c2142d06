"""Stepwise roll-ups along the keys of the star schema.

A measure is summed per key before each join.  The sum is combined map-side, so
a key that holds a large share of the rows reaches the shuffle as one row per
task, and each join meets a key once.  The sums are exact decimals, which makes
the order of the steps irrelevant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.functions import amount, revenue
from tarnwheel.operators import join_suffix

def rows():
    return F.count(F.lit(1))


def fold(df: DataFrame, *keys: str, **measures: Column) -> DataFrame:
    """Sum every measure per key."""
    return df.groupBy(*keys).agg(*[F.sum(value).alias(name) for name, value in measures.items()])


def refold(df: DataFrame, *keys: str, measures: tuple[str, ...] = ("rev",)) -> DataFrame:
    """Sum already folded measures per coarser key."""
    return fold(df, *keys, **{name: F.col(name) for name in measures})


def revenue_per_order(t) -> DataFrame:
    return fold(t.lineitem, "l_orderkey", rev=revenue())


def lines_per_order(lines: DataFrame) -> DataFrame:
    return lines.groupBy("l_orderkey").agg(rows().alias("n"))


def with_orders(per_order: DataFrame, orders: DataFrame) -> DataFrame:
    return join_suffix(per_order, orders, left_on="l_orderkey", right_on="o_orderkey")


def per_customer(
    per_order: DataFrame, orders: DataFrame, measures: tuple[str, ...] = ("rev",)
) -> DataFrame:
    return refold(with_orders(per_order, orders), "o_custkey", measures=measures)


def per_customer_nation(t, by_customer: DataFrame, measures: tuple[str, ...] = ("rev",)) -> DataFrame:
    """From customers to nations; adds the nation columns."""
    customers = t.customer.select("c_custkey", "c_nationkey")
    placed = join_suffix(by_customer, customers, left_on="o_custkey", right_on="c_custkey")
    folded = refold(placed, "c_nationkey", measures=measures)
    return join_suffix(folded, t.nation, left_on="c_nationkey", right_on="n_nationkey")


def per_supplier_nation(t, by_supplier: DataFrame, measures: tuple[str, ...] = ("rev",)) -> DataFrame:
    """From suppliers to nations; adds the nation columns."""
    suppliers = t.supplier.select("s_suppkey", "s_nationkey")
    placed = join_suffix(by_supplier, suppliers, left_on="l_suppkey", right_on="s_suppkey")
    folded = refold(placed, "s_nationkey", measures=measures)
    return join_suffix(folded, t.nation, left_on="s_nationkey", right_on="n_nationkey")


def with_region(t, by_nation: DataFrame) -> DataFrame:
    return join_suffix(by_nation, t.region, left_on="n_regionkey", right_on="r_regionkey")


def dp2(name: str) -> Column:
    """A folded amount with two places, as a double."""
    return F.round(amount(name), 2).cast("double")
