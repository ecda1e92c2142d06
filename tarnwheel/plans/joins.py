"""JOI01–JOI15: equi-joins, anti-joins, chains and repeated dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwheel.functions import iso_dates, iso_year, money, revenue, sum_dp
from tarnwheel.operators import anti_join, join_suffix, top_k

from .catalogue import SQL_REVENUE, query, sql_date, sql_money, sql_sum
from .rollups import rows, dp2, fold, per_customer_nation, refold


@query(
    "joi01_line_with_part",
    """SELECT l_orderkey, l_linenumber, l_suppkey, p_name, l_extendedprice
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def joi01(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    joined = join_suffix(lines, t.part.select("p_partkey", "p_name"), left_on="l_partkey", right_on="p_partkey")
    return joined.select("l_orderkey", "l_linenumber", "l_suppkey", "p_name", "l_extendedprice")


@query(
    "joi02_nation_and_region_name",
    """SELECT n_name AS name, r_name AS region_name
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def joi02(t):
    nations = t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    regions = t.region.select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
    return join_suffix(nations, regions, "region").select("name", F.col("name_right").alias("region_name"))


@query(
    "joi03_supplier_with_nation",
    "SELECT s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def joi03(t):
    joined = join_suffix(t.supplier, t.nation, left_on="s_nationkey", right_on="n_nationkey")
    return joined.select("s_name", "n_name", "s_acctbal")


@query(
    "joi04_orders_of_one_segment",
    f"""SELECT o_orderkey, c_name, {sql_date('o_orderdate')} AS o_orderdate
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'""",
)
def joi04(t):
    joined = join_suffix(t.orders, t.customer, left_on="o_custkey", right_on="c_custkey")
    chosen = joined.where(F.col("c_mktsegment") == "MACHINERY")
    return iso_dates(chosen.select("o_orderkey", "c_name", "o_orderdate"))


@query(
    "joi05_customer_nation_region",
    """SELECT c_name, n_name, r_name, c_mktsegment FROM customer
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def joi05(t):
    nations = join_suffix(t.customer, t.nation, left_on="c_nationkey", right_on="n_nationkey")
    regions = join_suffix(nations, t.region, left_on="n_regionkey", right_on="r_regionkey")
    return regions.select("c_name", "n_name", "r_name", "c_mktsegment")


@query(
    "joi06_line_with_part_and_supplier",
    """SELECT l_orderkey, l_linenumber, p_name AS part_name, s_name AS supplier_name,
              strftime(l_shipdate, '%Y') AS year
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
)
def joi06(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    parts = join_suffix(lines, t.part.select("p_partkey", "p_name"), left_on="l_partkey", right_on="p_partkey")
    both = join_suffix(
        parts, t.supplier.select("s_suppkey", "s_name"), left_on="l_suppkey", right_on="s_suppkey"
    )
    return both.select(
        "l_orderkey",
        "l_linenumber",
        F.col("p_name").alias("part_name"),
        F.col("s_name").alias("supplier_name"),
        iso_year("l_shipdate").alias("year"),
    )


@query(
    "joi07_orders_never_shipped",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               {sql_date('o_orderdate')} AS o_orderdate, o_orderpriority
        FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def joi07(t):
    return iso_dates(anti_join(t.orders, t.lineitem, "o_orderkey", "l_orderkey"))


@query(
    "joi08_customers_without_events",
    "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
)
def joi08(t):
    return join_suffix(t.customer, t.events, left_on="c_custkey", right_on="user_id", how="anti")


@query(
    "joi09_revenue_per_type",
    f"""SELECT p_type, {sql_sum(SQL_REVENUE)} AS total_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type ORDER BY total_revenue DESC""",
)
def joi09(t):
    per_part = fold(t.lineitem, "l_partkey", rev=revenue())
    parts = t.part.select("p_partkey", "p_type")
    typed = join_suffix(per_part, parts, left_on="l_partkey", right_on="p_partkey")
    return (
        typed.groupBy("p_type").agg(sum_dp("rev").alias("total_revenue")).orderBy(F.desc("total_revenue"), "p_type")
    )


@query(
    "joi10_order_value_per_nation",
    f"""SELECT n_name, {sql_sum(sql_money('o_totalprice'))} AS total_value FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name ORDER BY total_value DESC""",
)
def joi10(t):
    by_customer = fold(t.orders, "o_custkey", rev=money("o_totalprice"))
    by_nation = refold(per_customer_nation(t, by_customer), "n_name")
    return by_nation.select("n_name", dp2("rev").alias("total_value")).orderBy(F.desc("total_value"), "n_name")


@query(
    "joi11_most_ordered_part",
    """SELECT p_name, line_count FROM
         (SELECT l_partkey, count(*) AS line_count FROM lineitem
          GROUP BY l_partkey ORDER BY line_count DESC, l_partkey LIMIT 1)
       JOIN part ON l_partkey = p_partkey""",
)
def joi11(t):
    counted = t.lineitem.groupBy("l_partkey").agg(rows().alias("line_count"))
    best = top_k(counted, 1, "line_count", "l_partkey")
    return join_suffix(best, t.part, left_on="l_partkey", right_on="p_partkey").select("p_name", "line_count")


@query(
    "joi12_order_customer_nation_region",
    """SELECT o_orderkey, c_name, n_name, r_name FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey""",
)
def joi12(t):
    customers = join_suffix(
        t.orders.select("o_orderkey", "o_custkey"), t.customer, left_on="o_custkey", right_on="c_custkey"
    )
    nations = join_suffix(customers, t.nation, left_on="c_nationkey", right_on="n_nationkey")
    regions = join_suffix(nations, t.region, left_on="n_regionkey", right_on="r_regionkey")
    return regions.select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "joi13_most_purchased_brand",
    f"""SELECT p_brand AS brand, {sql_sum(sql_money('l_quantity'))} AS total_purchased
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY p_brand ORDER BY total_purchased DESC, brand LIMIT 1""",
)
def joi13(t):
    per_part = fold(t.lineitem, "l_partkey", qty=money("l_quantity"))
    parts = t.part.select("p_partkey", "p_brand")
    branded = join_suffix(per_part, parts, left_on="l_partkey", right_on="p_partkey")
    totals = branded.groupBy(F.col("p_brand").alias("brand")).agg(sum_dp("qty").alias("total_purchased"))
    return top_k(totals, 1, "total_purchased", "brand")


@query(
    "joi14_nation_with_head_nation",
    """SELECT a.n_name, a.n_nationkey, b.n_name AS head_name
       FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey WHERE a.n_regionkey IS NOT NULL""",
)
def joi14(t):
    reporting = t.nation.where(F.col("n_regionkey").isNotNull())
    joined = join_suffix(
        reporting, t.nation, left_on="n_regionkey", right_on="n_nationkey", suffix="_mgr"
    )
    return joined.select("n_name", "n_nationkey", F.col("n_name_mgr").alias("head_name"))


@query(
    "joi15_lines_from_one_nation",
    """SELECT l_orderkey, l_linenumber, l_suppkey, src.n_name AS source, dst.n_name AS destination
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation src ON s_nationkey = src.n_nationkey
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation dst ON c_nationkey = dst.n_nationkey
       WHERE src.n_name = 'NATION_3' AND l_discount < 0.05""",
)
def joi15(t):
    lines = t.lineitem.where(F.col("l_discount") < 0.05).select("l_orderkey", "l_linenumber", "l_suppkey")
    suppliers = join_suffix(
        t.supplier.select("s_suppkey", "s_nationkey"), t.nation, left_on="s_nationkey", right_on="n_nationkey"
    ).where(F.col("n_name") == "NATION_3")
    sent = join_suffix(
        lines, suppliers.select("s_suppkey", "n_name"), left_on="l_suppkey", right_on="s_suppkey"
    )
    ordered = join_suffix(
        sent, t.orders.select("o_orderkey", "o_custkey"), left_on="l_orderkey", right_on="o_orderkey"
    )
    placed = join_suffix(
        ordered, t.customer.select("c_custkey", "c_nationkey"), left_on="o_custkey", right_on="c_custkey"
    )
    both = join_suffix(
        placed, t.nation, left_on="c_nationkey", right_on="n_nationkey", suffix="_dst"
    )
    return both.select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("n_name").alias("source"),
        F.col("n_name_dst").alias("destination"),
    )
