"""WIN01–WIN15: ranks, running values and shares inside a key.

All orders end in a unique key, so every result is defined.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwheel.functions import amount, day_gap, iso_date, iso_dates, money, ratio, revenue, round_dp
from tarnwheel.operators import (
    dense_rank_desc,
    group_totals,
    ordinal_rank,
    previous_value,
    rolling_mean,
    running_count,
    running_sum,
)

from .catalogue import query, sql_date, sql_money, sql_round

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SQL_LINE_KEY = ", ".join(LINE_KEY)
SQL_ORDER_DATE = f"{sql_date('o_orderdate')} AS o_orderdate"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query(
    "win01_rank_lines_in_order",
    f"""SELECT *, CASE WHEN revenue IS NOT NULL THEN
               dense_rank() OVER (PARTITION BY l_orderkey ORDER BY revenue DESC) END AS rank_in_order
        FROM (SELECT {SQL_LINE_KEY},
                     CAST(round({sql_money('l_extendedprice')} * CAST(l_quantity AS DECIMAL(10,0)), 2)
                          AS DOUBLE) AS revenue FROM lineitem)""",
)
def win01(t):
    value = amount(revenue(discount=None, quantity="l_quantity")).cast("double")
    lines = t.lineitem.select(*LINE_KEY, value.alias("revenue"))
    return dense_rank_desc(lines, "revenue", ["l_orderkey"], "rank_in_order")


@query(
    "win02_running_total_per_customer",
    f"""SELECT o_orderkey, o_custkey, o_totalprice, {SQL_ORDER_DATE},
               CAST(sum({sql_money('o_totalprice')}) OVER (PARTITION BY o_custkey
                    ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total
        FROM orders""",
)
def win02(t):
    summed = running_sum(
        _orders(t), money("o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "running_total"
    )
    return iso_dates(summed.withColumn("running_total", amount("running_total").cast("double")))


@query(
    "win03_price_rank_per_customer",
    f"""SELECT o_orderkey, o_custkey, o_totalprice, {SQL_ORDER_DATE},
               dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS price_rank
        FROM orders""",
)
def win03(t):
    return iso_dates(dense_rank_desc(_orders(t), "o_totalprice", ["o_custkey"], "price_rank"))


@query(
    "win04_days_since_previous_order",
    f"""SELECT o_orderkey, o_custkey, {SQL_ORDER_DATE},
               CAST(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE))
                    AS DOUBLE) AS days_since_prev
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def win04(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    before = previous_value(
        orders, "o_orderdate", ["o_custkey"], ["o_orderdate", "o_orderkey"], "before"
    )
    return before.select(
        "o_orderkey",
        "o_custkey",
        iso_date("o_orderdate").alias("o_orderdate"),
        day_gap("o_orderdate", "before").cast("double").alias("days_since_prev"),
    )


@query(
    "win05_share_of_customer_total",
    f"""SELECT o_orderkey, o_custkey, o_totalprice,
               {sql_round(f"o_totalprice / CAST(sum({sql_money('o_totalprice')}) OVER (PARTITION BY o_custkey) AS DOUBLE) * 100", 2)}
                 AS pct_of_total
        FROM orders""",
)
def win05(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    held = group_totals(orders, ["o_custkey"], total=F.sum(money("o_totalprice")))
    share = round_dp(ratio("o_totalprice", amount("total")) * 100, 2)
    return held.withColumn("pct_of_total", share).drop("total")


@query(
    "win06_cumulative_price_per_order",
    f"""SELECT {SQL_LINE_KEY}, l_extendedprice,
               CAST(sum({sql_money('l_extendedprice')}) OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)
                    AS DOUBLE) AS cum_price
        FROM lineitem""",
)
def win06(t):
    lines = t.lineitem.select(*LINE_KEY, "l_extendedprice")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    summed = running_sum(lines, money("l_extendedprice"), ["l_orderkey"], order, "cum_price")
    return summed.withColumn("cum_price", amount("cum_price").cast("double"))


@query(
    "win07_order_number_per_customer",
    f"""SELECT o_orderkey, o_custkey, {SQL_ORDER_DATE},
               count(o_orderkey) OVER (PARTITION BY o_custkey
                    ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS order_number
        FROM orders""",
)
def win07(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    order = ["o_orderdate", "o_orderkey"]
    return iso_dates(running_count(orders, "o_orderkey", ["o_custkey"], order, "order_number"))


@query(
    "win08_quantity_minus_part_mean",
    f"""SELECT {SQL_LINE_KEY}, l_quantity,
               {sql_round(f"l_quantity - CAST(sum({sql_money('l_quantity')}) OVER w AS DOUBLE) / count(l_quantity) OVER w", 2)}
                 AS qty_diff_from_avg
        FROM lineitem WINDOW w AS (PARTITION BY l_partkey)""",
)
def win08(t):
    lines = t.lineitem.select(*LINE_KEY, "l_quantity")
    held = group_totals(
        lines, ["l_partkey"], total=F.sum(money("l_quantity")), n=F.count("l_quantity")
    )
    gap = round_dp(F.col("l_quantity") - ratio(amount("total"), "n"), 2)
    return held.withColumn("qty_diff_from_avg", gap).drop("total", "n")


@query(
    "win09_is_latest_order",
    f"""SELECT o_orderkey, o_custkey, {SQL_ORDER_DATE},
               o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) AS is_latest
        FROM orders""",
)
def win09(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    held = group_totals(orders, ["o_custkey"], last=F.max("o_orderdate"))
    return iso_dates(held.withColumn("is_latest", F.col("o_orderdate") == F.col("last")).drop("last"))


@query(
    "win10_percent_position_of_order",
    f"""SELECT o_orderkey, o_custkey, o_totalprice,
               {sql_round("CAST(r AS DOUBLE) / max(r) OVER (PARTITION BY o_custkey) * 100", 1)} AS pct_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r
              FROM orders)""",
)
def win10(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    ranked = ordinal_rank(orders, ["o_custkey"], ["o_totalprice", "o_orderkey"], "r")
    held = group_totals(ranked, ["o_custkey"], last=F.max("r"))
    return held.withColumn("pct_rank", round_dp(ratio("r", "last") * 100, 1)).drop("r", "last")


@query(
    "win11_balance_rank_per_nation",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal,
              dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS balance_rank
       FROM customer""",
)
def win11(t):
    customers = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return dense_rank_desc(customers, "c_acctbal", ["c_nationkey"], "balance_rank")


@query(
    "win12_line_share_of_order",
    f"""SELECT {SQL_LINE_KEY}, l_extendedprice,
               {sql_round(f"l_extendedprice / CAST(sum({sql_money('l_extendedprice')}) OVER (PARTITION BY l_orderkey) AS DOUBLE) * 100", 2)}
                 AS pct_of_order
        FROM lineitem""",
)
def win12(t):
    lines = t.lineitem.select(*LINE_KEY, "l_extendedprice")
    held = group_totals(lines, ["l_orderkey"], total=F.sum(money("l_extendedprice")))
    share = round_dp(ratio("l_extendedprice", amount("total")) * 100, 2)
    return held.withColumn("pct_of_order", share).drop("total")


@query(
    "win13_price_zscore_per_brand",
    f"""SELECT p_partkey, p_brand, p_retailprice,
               {sql_round(f"(p_retailprice - CAST(sum({sql_money('p_retailprice')}) OVER w AS DOUBLE) / count(*) OVER w) / nullif(stddev_samp(p_retailprice) OVER w, 0)", 2)}
                 AS price_zscore
        FROM part WINDOW w AS (PARTITION BY p_brand)""",
)
def win13(t):
    parts = t.part.select("p_partkey", "p_brand", "p_retailprice")
    held = group_totals(
        parts,
        ["p_brand"],
        total=F.sum(money("p_retailprice")),
        n=F.count("p_retailprice"),
        spread=F.stddev_samp("p_retailprice"),
    )
    score = round_dp(ratio(F.col("p_retailprice") - ratio(amount("total"), "n"), F.col("spread")), 2)
    return held.withColumn("price_zscore", score).drop("total", "n", "spread")


@query(
    "win14_rolling_mean_per_priority",
    f"""SELECT o_orderkey, o_orderpriority, {SQL_ORDER_DATE}, o_totalprice,
               CASE WHEN count(o_totalprice) OVER w = 3 THEN
                 {sql_round(f"CAST(sum({sql_money('o_totalprice')}) OVER w AS DOUBLE) / 3", 4)} END AS rolling_avg_3
        FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey
                                 ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def win14(t):
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    rolled = rolling_mean(
        orders,
        money("o_totalprice"),
        ["o_orderpriority"],
        ["o_orderdate", "o_orderkey"],
        3,
        "rolling_avg_3",
        total=amount,
    )
    return iso_dates(rolled.withColumn("rolling_avg_3", round_dp("rolling_avg_3", 4)))


@query(
    "win15_cumulative_price_per_supplier",
    f"""SELECT {SQL_LINE_KEY}, {sql_date('l_shipdate')} AS l_shipdate, l_extendedprice,
               CAST(sum({sql_money('l_extendedprice')}) OVER (PARTITION BY l_suppkey
                    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice
                    ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum_revenue
        FROM lineitem""",
)
def win15(t):
    lines = t.lineitem.select(*LINE_KEY, "l_shipdate", "l_extendedprice")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    summed = running_sum(lines, money("l_extendedprice"), ["l_suppkey"], order, "cum_revenue")
    return iso_dates(summed.withColumn("cum_revenue", amount("cum_revenue").cast("double")))
