"""OPT01–OPT30: the final set, from simple filters to multi-way roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwheel.functions import (
    amount,
    in_year,
    iso_month,
    mean_dp,
    money,
    n_unique,
    ratio,
    revenue,
    round_dp,
    sum_dp,
    whole_days,
)
from tarnwheel.operators import (
    arg_first,
    dense_rank_desc,
    group_totals,
    join_suffix,
    running_sum,
    top_k,
)
from tarnwheel.session import reliable

from .catalogue import (
    SQL_REVENUE,
    query,
    sql_date,
    sql_mean,
    sql_money,
    sql_month,
    sql_round,
    sql_sum,
)
from .full import SQL_TO_NATION, SQL_TO_REGION
from .rollups import (
    rows,
    dp2,
    fold,
    lines_per_order,
    per_customer,
    per_customer_nation,
    per_supplier_nation,
    refold,
    revenue_per_order,
    with_orders,
    with_region,
)

SQL_TO_SUPPLIER_NATION = "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


@query("opt01_parts_over_price", "SELECT p_name, p_retailprice FROM part WHERE p_retailprice > 950")
def opt01(t):
    return t.part.where(F.col("p_retailprice") > 950).select("p_name", "p_retailprice")


@query("opt02_parts_per_size", "SELECT p_size, count(*) AS count FROM part GROUP BY p_size")
def opt02(t):
    return t.part.groupBy("p_size").agg(rows().alias("count"))


@query("opt03_negative_balances", "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal < 0")
def opt03(t):
    return t.customer.where(F.col("c_acctbal") < 0).select("c_name", "c_acctbal")


@query("opt04_parts_under_minimum", "SELECT p_name, p_retailprice FROM part WHERE p_retailprice < 905")
def opt04(t):
    return t.part.where(F.col("p_retailprice") < 905).select("p_name", "p_retailprice")


@query(
    "opt05_asian_nations",
    "SELECT n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
def opt05(t):
    asia = with_region(t, t.nation).where(F.col("r_name") == "ASIA")
    return asia.select("n_name", "n_nationkey")


@query(
    "opt06_lines_of_cheap_parts",
    """SELECT l_orderkey, l_linenumber, p_name, p_type FROM lineitem
       JOIN part ON l_partkey = p_partkey WHERE p_retailprice < 910""",
)
def opt06(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    joined = join_suffix(lines, t.part, left_on="l_partkey", right_on="p_partkey")
    return joined.where(F.col("p_retailprice") < 910).select("l_orderkey", "l_linenumber", "p_name", "p_type")


@query(
    "opt07_orders_per_segment",
    """SELECT c_mktsegment, count(*) AS order_count FROM orders
       JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def opt07(t):
    counted = t.orders.groupBy("o_custkey").agg(rows().alias("n"))
    placed = join_suffix(
        counted, t.customer.select("c_custkey", "c_mktsegment"), left_on="o_custkey", right_on="c_custkey"
    )
    return placed.groupBy("c_mktsegment").agg(F.sum("n").alias("order_count"))


@query(
    "opt08_large_orders_per_customer",
    f"""SELECT o_custkey, {sql_sum(sql_money('o_totalprice'))} AS total FROM orders
        WHERE o_totalprice > 250000 GROUP BY o_custkey""",
)
def opt08(t):
    large = t.orders.where(F.col("o_totalprice") > 250000)
    return large.groupBy("o_custkey").agg(sum_dp(money("o_totalprice")).alias("total"))


@query(
    "opt09_revenue_per_part",
    f"""SELECT l_partkey, {sql_sum(SQL_REVENUE)} AS total_revenue FROM lineitem
        GROUP BY l_partkey ORDER BY total_revenue DESC""",
)
def opt09(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(sum_dp(revenue()).alias("total_revenue"))
    return per_part.orderBy(F.desc("total_revenue"), "l_partkey")


@query(
    "opt10_mean_price_of_common_types",
    f"""SELECT * FROM (SELECT p_type AS type,
               {sql_round(f"CAST(sum({sql_money('l_extendedprice')}) AS DOUBLE) / count(*) / 1000", 1)}
                 AS avg_thousands, count(*) AS n_lines
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)
        WHERE n_lines > 9800""",
)
def opt10(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(
        F.sum(money("l_extendedprice")).alias("price"), rows().alias("n")
    )
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("price"))
    typed = join_suffix(per_part, parts, "l_partkey")
    per_type = typed.groupBy(F.col("price_right").alias("type")).agg(
        round_dp(ratio(ratio(amount(F.sum("price")), F.sum("n")), F.lit(1000)), 1).alias("avg_thousands"),
        F.sum("n").alias("n_lines"),
    )
    return per_type.where(F.col("n_lines") > 9800)


@query(
    "opt11_revenue_per_type_of_1997",
    f"""SELECT p_type, {sql_sum(SQL_REVENUE)} AS total_revenue FROM lineitem
        JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        WHERE strftime(o_orderdate, '%Y') = '1997' GROUP BY p_type ORDER BY total_revenue DESC""",
)
def opt11(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", revenue().alias("rev"))
    sold = with_orders(lines, t.orders.where(in_year("o_orderdate", 1997)).select("o_orderkey"))
    typed = join_suffix(
        refold(sold, "l_partkey"),
        t.part.select("p_partkey", "p_type"),
        left_on="l_partkey",
        right_on="p_partkey",
    )
    totals = typed.groupBy("p_type").agg(sum_dp("rev").alias("total_revenue"))
    return totals.orderBy(F.desc("total_revenue"), "p_type")


@query(
    "opt12_revenue_per_nation_of_finished_orders",
    f"""SELECT n_name, {sql_sum(SQL_REVENUE)} AS total_rev FROM lineitem {SQL_TO_NATION}
        WHERE o_orderstatus = 'F' GROUP BY n_name ORDER BY total_rev DESC""",
)
def opt12(t):
    finished = t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
    nations = per_customer_nation(t, per_customer(revenue_per_order(t), finished))
    totals = nations.groupBy("n_name").agg(sum_dp("rev").alias("total_rev"))
    return totals.orderBy(F.desc("total_rev"), "n_name")


@query(
    "opt13_lines_per_region_of_1997",
    f"""SELECT r_name, count(*) AS line_count FROM lineitem {SQL_TO_REGION}
        WHERE strftime(l_shipdate, '%Y') = '1997' GROUP BY r_name ORDER BY line_count DESC""",
)
def opt13(t):
    shipped = t.lineitem.where(in_year("l_shipdate", 1997))
    counted = per_customer(lines_per_order(shipped), t.orders.select("o_orderkey", "o_custkey"), ("n",))
    regions = with_region(t, per_customer_nation(t, counted, ("n",)))
    totals = regions.groupBy("r_name").agg(F.sum("n").alias("line_count"))
    return totals.orderBy(F.desc("line_count"), "r_name")


@query(
    "opt14_revenue_per_nation",
    f"""SELECT n_name, {sql_sum(SQL_REVENUE)} AS total_sales FROM lineitem {SQL_TO_NATION}
        GROUP BY n_name ORDER BY total_sales DESC""",
)
def opt14(t):
    spent = per_customer(revenue_per_order(t), t.orders.select("o_orderkey", "o_custkey"))
    totals = per_customer_nation(t, spent).groupBy("n_name").agg(sum_dp("rev").alias("total_sales"))
    return totals.orderBy(F.desc("total_sales"), "n_name")


@query(
    "opt15_mean_order_value_per_nation",
    f"""SELECT n_name, {sql_mean(sql_money('o_totalprice'), 2)} AS avg_value FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE nullif(o_orderstatus, 'P') IS NOT NULL
        GROUP BY n_name ORDER BY avg_value DESC, n_name LIMIT 5""",
)
def opt15(t):
    settled = t.orders.where(F.nullif(F.col("o_orderstatus"), F.lit("P")).isNotNull())
    counted = fold(settled, "o_custkey", rev=money("o_totalprice"), n=F.lit(1))
    nations = per_customer_nation(t, counted, ("rev", "n"))
    means = nations.groupBy("n_name").agg(
        round_dp(ratio(amount(F.sum("rev")), F.sum("n")), 2).alias("avg_value")
    )
    return top_k(means, 5, "avg_value", "n_name")


@query(
    "opt16_revenue_of_small_parts_per_brand",
    f"""SELECT p_brand, {sql_sum(SQL_REVENUE)} AS total_rev FROM lineitem
        JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY p_brand ORDER BY total_rev DESC""",
)
def opt16(t):
    small = t.part.where(F.col("p_size") < 10).select("p_partkey", "p_brand")
    per_part = fold(t.lineitem, "l_partkey", rev=revenue())
    branded = join_suffix(per_part, small, left_on="l_partkey", right_on="p_partkey")
    totals = branded.groupBy("p_brand").agg(sum_dp("rev").alias("total_rev"))
    return totals.orderBy(F.desc("total_rev"), "p_brand")


def _delivery_days(t, p_type: str):
    """Lines of one part type with whole days from order to shipment."""
    parts = t.part.where(F.col("p_type") == p_type).select("p_partkey")
    lines = t.lineitem.where(F.col("l_shipdate").isNotNull()).select("l_orderkey", "l_partkey", "l_shipdate")
    sold = join_suffix(lines, parts, left_on="l_partkey", right_on="p_partkey")
    placed = with_orders(sold, t.orders.select("o_orderkey", "o_custkey", "o_orderdate"))
    return placed.select("o_custkey", whole_days("l_shipdate", "o_orderdate").alias("days"))


def mean_days():
    return round_dp(ratio(F.sum("days"), F.count("days")), 1)


@query(
    "opt17_mean_delivery_days",
    f"""SELECT {sql_mean("date_sub('day', o_orderdate, l_shipdate)", 1)} AS avg_days FROM lineitem
        JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        WHERE p_type = 'SMALL' AND l_shipdate IS NOT NULL""",
)
def opt17(t):
    return _delivery_days(t, "SMALL").agg(mean_days().alias("avg_days"))


@query(
    "opt18_revenue_per_supplier_nation_of_1997",
    f"""SELECT n_name, {sql_sum(SQL_REVENUE)} AS total_rev FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey {SQL_TO_SUPPLIER_NATION}
        WHERE strftime(o_orderdate, '%Y') = '1997' GROUP BY n_name ORDER BY total_rev DESC""",
)
def opt18(t):
    lines = t.lineitem.select("l_orderkey", "l_suppkey", revenue().alias("rev"))
    sold = with_orders(lines, t.orders.where(in_year("o_orderdate", 1997)).select("o_orderkey"))
    nations = per_supplier_nation(t, refold(sold, "l_suppkey"))
    totals = nations.groupBy("n_name").agg(sum_dp("rev").alias("total_rev"))
    return totals.orderBy(F.desc("total_rev"), "n_name")


@query(
    "opt19_best_customers_of_urgent_orders",
    f"""SELECT c_name, {sql_sum(SQL_REVENUE)} AS total_rev FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE o_orderpriority = '1-URGENT' GROUP BY c_name ORDER BY total_rev DESC, c_name LIMIT 5""",
)
def opt19(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")
    spent = per_customer(revenue_per_order(t), urgent)
    named = join_suffix(
        spent, t.customer.select("c_custkey", "c_name"), left_on="o_custkey", right_on="c_custkey"
    )
    totals = named.groupBy("c_name").agg(sum_dp("rev").alias("total_rev"))
    return top_k(totals, 5, "total_rev", "c_name")


@query(
    "opt20_spending_per_nation_of_1998",
    f"""SELECT n_name, {sql_sum(SQL_REVENUE)} AS total FROM lineitem {SQL_TO_NATION}
        WHERE strftime(o_orderdate, '%Y') = '1998' GROUP BY n_name ORDER BY total DESC""",
)
def opt20(t):
    orders = t.orders.where(in_year("o_orderdate", 1998)).select("o_orderkey", "o_custkey")
    nations = per_customer_nation(t, per_customer(revenue_per_order(t), orders))
    totals = nations.groupBy("n_name").agg(sum_dp("rev").alias("total"))
    return totals.orderBy(F.desc("total"), "n_name")


@query(
    "opt21_running_total_and_customer_rank",
    f"""WITH held AS (SELECT o_orderkey, o_custkey, {sql_date('o_orderdate')} AS o_orderdate, o_totalprice,
           CAST(sum({sql_money('o_totalprice')}) OVER (PARTITION BY o_custkey
                ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total,
           CAST(sum({sql_money('o_totalprice')}) OVER (PARTITION BY o_custkey) AS DOUBLE) AS customer_total
         FROM orders)
        SELECT *, dense_rank() OVER (ORDER BY customer_total DESC) AS customer_rank FROM held""",
)
def opt21(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    summed = running_sum(
        orders, money("o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "running_total"
    )
    totals = reliable(orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("customer_total")))
    ranked = dense_rank_desc(totals, "customer_total", [], "customer_rank").withColumnRenamed("o_custkey", "customer")
    held = summed.join(ranked, F.col("o_custkey").eqNullSafe(F.col("customer"))).drop("customer")
    return held.withColumns(
        {
            "o_orderdate": F.to_date("o_orderdate").cast("string"),
            "running_total": amount("running_total").cast("double"),
            "customer_total": amount("customer_total").cast("double"),
        }
    )


@query(
    "opt22_mean_revenue_per_flag",
    f"""SELECT l_returnflag, {sql_mean(SQL_REVENUE, 2)} AS avg_rev, count(*) AS n_lines
        FROM lineitem GROUP BY l_returnflag ORDER BY avg_rev DESC""",
)
def opt22(t):
    per_flag = t.lineitem.groupBy("l_returnflag").agg(
        mean_dp(revenue(), 2).alias("avg_rev"), rows().alias("n_lines")
    )
    return per_flag.orderBy(F.desc("avg_rev"), "l_returnflag")


@query(
    "opt23_monthly_orders_and_revenue_of_1997",
    f"""SELECT {sql_month('o_orderdate')} AS month, count(DISTINCT o_orderkey) AS n_orders,
               {sql_sum(SQL_REVENUE)} AS total_rev
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE strftime(o_orderdate, '%Y') = '1997' GROUP BY 1 ORDER BY 1""",
)
def opt23(t):
    orders = t.orders.where(in_year("o_orderdate", 1997)).select("o_orderkey", "o_orderdate")
    placed = with_orders(revenue_per_order(t), orders)
    return (
        placed.groupBy(iso_month("o_orderdate").alias("month"))
        .agg(rows().alias("n_orders"), sum_dp("rev").alias("total_rev"))
        .orderBy("month")
    )


@query(
    "opt24_mean_balance_per_nation_of_segment",
    f"""SELECT n_name, {sql_mean(sql_money('c_acctbal'), 1)} AS avg_balance FROM customer
        JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY n_name""",
)
def opt24(t):
    chosen = t.customer.where(F.col("c_mktsegment") == "HOUSEHOLD")
    placed = join_suffix(chosen, t.nation, left_on="c_nationkey", right_on="n_nationkey")
    return placed.groupBy("n_name").agg(mean_dp(money("c_acctbal"), 1).alias("avg_balance"))


@query(
    "opt25_lines_per_solvent_supplier",
    """SELECT s_name, count(*) AS line_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       WHERE s_acctbal > 0 GROUP BY s_name ORDER BY line_count DESC""",
)
def opt25(t):
    solvent = t.supplier.withColumn("solvent", F.col("s_acctbal") > 0).where("solvent")
    counted = t.lineitem.groupBy("l_suppkey").agg(rows().alias("n"))
    named = join_suffix(counted, solvent, left_on="l_suppkey", right_on="s_suppkey")
    totals = named.groupBy("s_name").agg(F.sum("n").alias("line_count"))
    return totals.orderBy(F.desc("line_count"), "s_name")


@query(
    "opt26_paid_and_lines_per_customer",
    f"""WITH paid AS (SELECT o_custkey, {sql_sum(sql_money('o_totalprice'))} AS total_paid
                      FROM orders GROUP BY o_custkey),
             counted AS (SELECT o_custkey, count(*) AS n_lines FROM lineitem
                         JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
        SELECT c_name, total_paid, n_lines,
               {sql_round("total_paid / nullif(n_lines, 0)", 2)} AS avg_per_line
        FROM paid JOIN counted USING (o_custkey) JOIN customer ON o_custkey = c_custkey
        WHERE c_acctbal > 0 ORDER BY total_paid DESC""",
)
def opt26(t):
    paid = t.orders.groupBy("o_custkey").agg(sum_dp(money("o_totalprice")).alias("total_paid"))
    counted = per_customer(lines_per_order(t.lineitem), t.orders.select("o_orderkey", "o_custkey"), ("n",))
    active = t.customer.where(F.col("c_acctbal") > 0).select("c_custkey", "c_name")
    both = join_suffix(paid, counted.withColumnRenamed("n", "n_lines"), "o_custkey")
    named = join_suffix(both, active, left_on="o_custkey", right_on="c_custkey")
    return (
        named.withColumn("avg_per_line", round_dp(ratio("total_paid", "n_lines"), 2))
        .select("c_name", "total_paid", "n_lines", "avg_per_line")
        .orderBy(F.desc("total_paid"), "c_name")
    )


@query(
    "opt27_cheapest_supplier_per_part",
    """SELECT l_partkey, best_supp, min_cost, n_name FROM
         (SELECT l_partkey, l_suppkey AS best_supp, l_extendedprice AS min_cost FROM lineitem
          QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey) = 1)
       JOIN supplier ON best_supp = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
)
def opt27(t):
    best = arg_first(
        [F.col("l_suppkey").alias("best_supp"), F.col("l_extendedprice").alias("min_cost")],
        [F.col("l_extendedprice"), F.col("l_suppkey")],
        largest=False,
    )
    per_part = t.lineitem.groupBy("l_partkey").agg(best.alias("best")).select("l_partkey", "best.*")
    supplied = join_suffix(per_part, t.supplier, left_on="best_supp", right_on="s_suppkey")
    named = join_suffix(supplied, t.nation, left_on="s_nationkey", right_on="n_nationkey")
    return named.select("l_partkey", "best_supp", "min_cost", "n_name")


@query(
    "opt28_best_customers_of_1998",
    f"""SELECT c_name, c_mktsegment, total_rev FROM
          (SELECT o_custkey, {sql_sum(SQL_REVENUE)} AS total_rev FROM lineitem
           JOIN orders ON l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y') = '1998'
           GROUP BY o_custkey ORDER BY total_rev DESC, o_custkey LIMIT 5)
        JOIN customer ON o_custkey = c_custkey""",
)
def opt28(t):
    orders = t.orders.where(in_year("o_orderdate", 1998)).select("o_orderkey", "o_custkey")
    spent = per_customer(revenue_per_order(t), orders).select("o_custkey", dp2("rev").alias("total_rev"))
    best = top_k(spent, 5, "total_rev", "o_custkey")
    named = join_suffix(best, t.customer, left_on="o_custkey", right_on="c_custkey")
    return named.select("c_name", "c_mktsegment", "total_rev")


@query(
    "opt29_revenue_per_region_of_one_brand",
    f"""SELECT r_name, {sql_sum(SQL_REVENUE)} AS total_rev FROM lineitem
        JOIN part ON l_partkey = p_partkey {SQL_TO_SUPPLIER_NATION}
        JOIN region ON n_regionkey = r_regionkey
        WHERE p_brand = 'Brand#3' GROUP BY r_name ORDER BY total_rev DESC""",
)
def opt29(t):
    parts = t.part.where(F.col("p_brand") == "Brand#3").select("p_partkey")
    lines = t.lineitem.select("l_partkey", "l_suppkey", revenue().alias("rev"))
    sold = join_suffix(lines, parts, left_on="l_partkey", right_on="p_partkey")
    regions = with_region(t, per_supplier_nation(t, refold(sold, "l_suppkey")))
    totals = regions.groupBy("r_name").agg(sum_dp("rev").alias("total_rev"))
    return totals.orderBy(F.desc("total_rev"), "r_name")


@query(
    "opt30_delivery_and_payment_per_customer",
    f"""WITH sent AS (SELECT o_custkey, {sql_mean("date_sub('day', o_orderdate, l_shipdate)", 1)} AS avg_days,
                      count(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey
                      JOIN orders ON l_orderkey = o_orderkey
                      WHERE p_type = 'LARGE' AND l_shipdate IS NOT NULL GROUP BY o_custkey),
             paid AS (SELECT o_custkey, {sql_sum(sql_money('o_totalprice'))} AS total_paid
                      FROM orders GROUP BY o_custkey)
        SELECT c_name, avg_days, n_lines, total_paid FROM sent JOIN paid USING (o_custkey)
        JOIN customer ON o_custkey = c_custkey ORDER BY total_paid DESC, c_name LIMIT 10""",
)
def opt30(t):
    sent = (
        _delivery_days(t, "LARGE")
        .groupBy("o_custkey")
        .agg(mean_days().alias("avg_days"), rows().alias("n_lines"))
    )
    paid = t.orders.groupBy("o_custkey").agg(sum_dp(money("o_totalprice")).alias("total_paid"))
    both = join_suffix(sent, paid, "o_custkey")
    named = join_suffix(
        both, t.customer.select("c_custkey", "c_name"), left_on="o_custkey", right_on="c_custkey"
    )
    return top_k(named.select("c_name", "avg_days", "n_lines", "total_paid"), 10, "total_paid", "c_name")
