"""AGG01–AGG15: grouped and global aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwheel.functions import (
    amount,
    iso_month,
    iso_year,
    mean_dp,
    money,
    ratio,
    revenue,
    round_dp,
    sum_dp,
    sum_or_zero,
)
from tarnwheel.operators import share_of_rows, top_k

from .catalogue import SQL_REVENUE, query, sql_mean, sql_money, sql_month, sql_round, sql_sum
from .rollups import rows


@query(
    "agg01_parts_per_type",
    "SELECT p_type, count(*) AS count FROM part GROUP BY p_type",
)
def agg01(t):
    return t.part.groupBy("p_type").agg(rows().alias("count"))


@query(
    "agg02_parts_per_brand",
    "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand",
)
def agg02(t):
    return t.part.groupBy("p_brand").agg(rows().alias("count"))


@query(
    "agg03_total_quantity_and_price",
    f"""SELECT {sql_sum(sql_money('l_quantity'))} AS total_qty,
               {sql_sum(sql_money('l_extendedprice'))} AS total_price
        FROM lineitem""",
)
def agg03(t):
    return t.lineitem.agg(
        sum_dp(money("l_quantity")).alias("total_qty"),
        sum_dp(money("l_extendedprice")).alias("total_price"),
    )


@query(
    "agg04_revenue_per_order",
    f"SELECT l_orderkey, {sql_sum(SQL_REVENUE)} AS total_revenue FROM lineitem GROUP BY l_orderkey",
)
def agg04(t):
    return t.lineitem.groupBy("l_orderkey").agg(sum_dp(revenue()).alias("total_revenue"))


@query(
    "agg05_sum_and_mean_per_priority",
    f"""SELECT o_orderpriority, {sql_sum(sql_money('o_totalprice'))} AS total,
               {sql_mean(sql_money('o_totalprice'), 2)} AS avg
        FROM orders GROUP BY o_orderpriority""",
)
def agg05(t):
    price = money("o_totalprice")
    return t.orders.groupBy("o_orderpriority").agg(
        sum_dp(price).alias("total"), mean_dp(price, 2).alias("avg")
    )


@query(
    "agg06_pricing_summary",
    f"""SELECT l_returnflag, l_linestatus,
               {sql_sum(sql_money('l_quantity'))} AS sum_qty,
               {sql_sum(sql_money('l_extendedprice'))} AS sum_price,
               {sql_mean(sql_money('l_discount'), 4)} AS avg_disc,
               count(*) AS count_order
        FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""",
)
def agg06(t):
    return (
        t.lineitem.groupBy("l_returnflag", "l_linestatus")
        .agg(
            sum_dp(money("l_quantity")).alias("sum_qty"),
            sum_dp(money("l_extendedprice")).alias("sum_price"),
            mean_dp(money("l_discount"), 4).alias("avg_disc"),
            rows().alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query(
    "agg07_orders_per_year",
    f"""SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS order_count,
               {sql_sum(sql_money('o_totalprice'))} AS total_sales
        FROM orders GROUP BY 1 ORDER BY 1""",
)
def agg07(t):
    return (
        t.orders.groupBy(iso_year("o_orderdate").alias("year"))
        .agg(rows().alias("order_count"), sum_dp(money("o_totalprice")).alias("total_sales"))
        .orderBy("year")
    )


@query(
    "agg08_best_part_by_revenue",
    f"""SELECT l_partkey, {sql_sum(SQL_REVENUE)} AS total_revenue
        FROM lineitem GROUP BY l_partkey ORDER BY total_revenue DESC, l_partkey LIMIT 1""",
)
def agg08(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(sum_dp(revenue()).alias("total_revenue"))
    return top_k(per_part, 1, "total_revenue", "l_partkey")


@query(
    "agg09_lines_per_month",
    f"""SELECT {sql_month('l_shipdate')} AS month, count(*) AS line_count
        FROM lineitem GROUP BY 1 ORDER BY 1""",
)
def agg09(t):
    return (
        t.lineitem.groupBy(iso_month("l_shipdate").alias("month"))
        .agg(rows().alias("line_count"))
        .orderBy("month")
    )


@query(
    "agg10_orders_per_priority_and_status",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS count
       FROM orders GROUP BY 1, 2 ORDER BY 1, 2""",
)
def agg10(t):
    return (
        t.orders.groupBy("o_orderpriority", "o_orderstatus")
        .agg(rows().alias("count"))
        .orderBy("o_orderpriority", "o_orderstatus")
    )


@query(
    "agg11_balance_per_segment",
    f"""SELECT c_mktsegment, {sql_sum(sql_money('c_acctbal'))} AS total_balance,
               {sql_mean(sql_money('c_acctbal'), 1)} AS avg_balance
        FROM customer GROUP BY c_mktsegment ORDER BY total_balance DESC""",
)
def agg11(t):
    balance = money("c_acctbal")
    return (
        t.customer.groupBy("c_mktsegment")
        .agg(sum_dp(balance).alias("total_balance"), mean_dp(balance, 1).alias("avg_balance"))
        .orderBy(F.desc("total_balance"), "c_mktsegment")
    )


@query(
    "agg12_mean_price_per_size",
    f"""SELECT p_size, {sql_mean(sql_money('p_retailprice'), 1)} AS avg_price
        FROM part GROUP BY p_size ORDER BY p_size""",
)
def agg12(t):
    return (
        t.part.groupBy("p_size").agg(mean_dp(money("p_retailprice"), 1).alias("avg_price")).orderBy("p_size")
    )


@query(
    "agg13_order_frequency",
    f"""SELECT min(n_orders) AS min_orders, max(n_orders) AS max_orders,
               {sql_mean('n_orders', 1)} AS avg_orders
        FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)""",
)
def agg13(t):
    per_customer = t.orders.groupBy("o_custkey").agg(rows().alias("n_orders"))
    return per_customer.agg(
        F.min("n_orders").alias("min_orders"),
        F.max("n_orders").alias("max_orders"),
        round_dp(ratio(F.sum("n_orders"), F.count("n_orders")), 1).alias("avg_orders"),
    )


@query(
    "agg14_scaled_sum_per_flag",
    f"""SELECT l_returnflag,
               {sql_round("CAST(sum(" + sql_money('l_extendedprice') + ") AS DOUBLE) / 1e6", 2)} AS total_millions
        FROM lineitem GROUP BY l_returnflag""",
)
def agg14(t):
    total = sum_or_zero(money("l_extendedprice"))
    return t.lineitem.groupBy("l_returnflag").agg(
        round_dp(ratio(amount(total), F.lit(1e6)), 2).alias("total_millions")
    )


@query(
    "agg15_mean_price_and_share_per_type",
    f"""SELECT p_type, {sql_mean(sql_money('p_retailprice'), 2)} AS avg_price,
               {sql_round("CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM part) * 100", 1)} AS pct_of_total
        FROM part GROUP BY p_type""",
)
def agg15(t):
    parts = t.part
    per_type = parts.groupBy("p_type").agg(
        mean_dp(money("p_retailprice"), 2).alias("avg_price"), rows().alias("n")
    )
    return per_type.select(
        "p_type", "avg_price", share_of_rows(per_type, "n", parts, 1).alias("pct_of_total")
    )
