"""PIP01–PIP15: complete analyses over several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwheel.functions import (
    amount,
    day_gap,
    iso_month,
    in_year,
    mean_dp,
    money,
    n_unique,
    ratio,
    revenue,
    round_dp,
    sum_dp,
)
from tarnwheel.operators import arg_first, growth_pct, join_suffix, pivot_sorted, top_k, top_pairs

from .catalogue import SQL_REVENUE, query, sql_mean, sql_money, sql_month, sql_round, sql_sum
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

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

SQL_TO_NATION = """JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey"""
SQL_TO_REGION = SQL_TO_NATION + " JOIN region ON n_regionkey = r_regionkey"


@query(
    "pip01_best_customers_of_promo_parts",
    f"""SELECT c_name, c_mktsegment, total_spent FROM
          (SELECT o_custkey, {sql_sum(SQL_REVENUE)} AS total_spent FROM lineitem
           JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
           WHERE p_type = 'PROMO' GROUP BY o_custkey ORDER BY total_spent DESC, o_custkey LIMIT 5)
        JOIN customer ON o_custkey = c_custkey""",
)
def pip01(t):
    promo = t.part.where(F.col("p_type") == "PROMO").select("p_partkey")
    lines = t.lineitem.select("l_orderkey", "l_partkey", revenue().alias("rev"))
    sold = join_suffix(lines, promo, left_on="l_partkey", right_on="p_partkey")
    spent = per_customer(refold(sold, "l_orderkey"), t.orders.select("o_orderkey", "o_custkey"))
    best = top_k(spent.select("o_custkey", dp2("rev").alias("total_spent")), 5, "total_spent", "o_custkey")
    named = join_suffix(best, t.customer, left_on="o_custkey", right_on="c_custkey")
    return named.select("c_name", "c_mktsegment", "total_spent")


@query(
    "pip02_revenue_per_european_nation",
    f"""SELECT n_name, {sql_sum(SQL_REVENUE)} AS total_revenue FROM lineitem {SQL_TO_REGION}
        WHERE r_name = 'EUROPE' GROUP BY n_name ORDER BY total_revenue DESC""",
)
def pip02(t):
    spent = per_customer(revenue_per_order(t), t.orders.select("o_orderkey", "o_custkey"))
    nations = with_region(t, per_customer_nation(t, spent)).where(F.col("r_name") == "EUROPE")
    return (
        nations.groupBy("n_name").agg(sum_dp("rev").alias("total_revenue")).orderBy(F.desc("total_revenue"), "n_name")
    )


@query(
    "pip03_region_with_most_lines",
    f"""SELECT r_name, count(*) AS line_count FROM lineitem {SQL_TO_REGION}
        GROUP BY r_name ORDER BY line_count DESC, r_name LIMIT 1""",
)
def pip03(t):
    counted = per_customer(lines_per_order(t.lineitem), t.orders.select("o_orderkey", "o_custkey"), ("n",))
    regions = with_region(t, per_customer_nation(t, counted, ("n",)))
    totals = regions.groupBy("r_name").agg(F.sum("n").alias("line_count"))
    return top_k(totals, 1, "line_count", "r_name")


def _revenue_with_two_names(t):
    """Customers and their nations both bring a column ``name``."""
    spent = per_customer(revenue_per_order(t), t.orders.select("o_orderkey", "o_custkey"))
    customers = t.customer.select("c_custkey", F.col("c_name").alias("name"), "c_nationkey")
    nations = t.nation.select("n_nationkey", F.col("n_name").alias("name"))
    named = join_suffix(spent, customers, left_on="o_custkey", right_on="c_custkey")
    return join_suffix(named, nations, left_on="c_nationkey", right_on="n_nationkey")


@query(
    "pip04_best_left_name_after_collision",
    f"""SELECT c_name AS name, {sql_sum(SQL_REVENUE)} AS total_rev FROM lineitem {SQL_TO_NATION}
        GROUP BY c_name ORDER BY total_rev DESC, name LIMIT 1""",
)
def pip04(t):
    totals = _revenue_with_two_names(t).groupBy("name").agg(sum_dp("rev").alias("total_rev"))
    return top_k(totals, 1, "total_rev", "name")


@query(
    "pip04_best_right_name_as_intended",
    f"""SELECT n_name AS nation, {sql_sum(SQL_REVENUE)} AS total_rev FROM lineitem {SQL_TO_NATION}
        GROUP BY n_name ORDER BY total_rev DESC, nation LIMIT 1""",
)
def pip04_intended(t):
    named = _revenue_with_two_names(t)
    totals = named.groupBy(F.col("name_right").alias("nation")).agg(sum_dp("rev").alias("total_rev"))
    return top_k(totals, 1, "total_rev", "nation")


@query(
    "pip05_monthly_growth_of_1997",
    f"""WITH monthly AS (SELECT {sql_month('o_orderdate')} AS month, {sql_sum(SQL_REVENUE)} AS monthly_rev
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          WHERE strftime(o_orderdate, '%Y') = '1997' GROUP BY 1)
        SELECT month, monthly_rev,
          {sql_round("(monthly_rev - lag(monthly_rev) OVER w) / nullif(lag(monthly_rev) OVER w, 0) * 100", 1)}
            AS growth_pct
        FROM monthly WINDOW w AS (ORDER BY month)""",
)
def pip05(t):
    orders = t.orders.where(in_year("o_orderdate", 1997))
    placed = with_orders(revenue_per_order(t), orders.select("o_orderkey", "o_orderdate"))
    monthly = (
        placed.groupBy(iso_month("o_orderdate").alias("month"))
        .agg(sum_dp("rev").alias("monthly_rev"))
    )
    # One row per month of one year.
    return growth_pct(monthly, "monthly_rev", "month", "growth_pct")


@query(
    "pip06_top_nations_for_standard_parts",
    f"""SELECT n_name, {sql_sum(sql_money('l_extendedprice'))} AS total_value FROM lineitem
        JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey WHERE p_type LIKE '%STANDARD%'
        GROUP BY n_name ORDER BY total_value DESC, n_name LIMIT 3""",
)
def pip06(t):
    standard = t.part.where(F.col("p_type").contains("STANDARD")).select("p_partkey")
    lines = t.lineitem.select("l_partkey", "l_suppkey", money("l_extendedprice").alias("rev"))
    sold = join_suffix(lines, standard, left_on="l_partkey", right_on="p_partkey")
    nations = per_supplier_nation(t, refold(sold, "l_suppkey"))
    totals = nations.groupBy("n_name").agg(sum_dp("rev").alias("total_value"))
    return top_k(totals, 3, "total_value", "n_name")


@query(
    "pip07_order_value_per_region",
    f"""SELECT r_name, {sql_sum(sql_money('o_totalprice'))} AS total_revenue FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY total_revenue DESC""",
)
def pip07(t):
    by_customer = fold(t.orders, "o_custkey", rev=money("o_totalprice"))
    regions = with_region(t, per_customer_nation(t, by_customer))
    return (
        regions.groupBy("r_name").agg(sum_dp("rev").alias("total_revenue")).orderBy(F.desc("total_revenue"), "r_name")
    )


@query(
    "pip08_recency_frequency_monetary",
    f"""SELECT o_custkey,
               date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2001-08-02') AS recency,
               count(DISTINCT o_orderkey) AS frequency, {sql_sum('order_rev')} AS monetary
        FROM (SELECT l_orderkey, sum({SQL_REVENUE}) AS order_rev FROM lineitem GROUP BY l_orderkey)
        JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey ORDER BY monetary DESC""",
)
def pip08(t):
    placed = with_orders(
        revenue_per_order(t), t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    )
    per = placed.groupBy("o_custkey").agg(
        day_gap(F.lit("2001-08-02").cast("date"), F.max(F.to_date("o_orderdate"))).alias("recency"),
        # One row per order here, so counting rows counts distinct orders.
        rows().alias("frequency"),
        sum_dp("rev").alias("monetary"),
    )
    return per.orderBy(F.desc("monetary"), "o_custkey")


@query(
    "pip09_top_type_per_supplier_nation",
    """WITH counted AS (SELECT n_name, p_type, count(*) AS n FROM lineitem
         JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
         JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
       SELECT n_name, p_type AS top_type, n AS line_count FROM counted
       QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY n DESC, p_type) = 1""",
)
def pip09(t):
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(rows().alias("n"))
    typed = join_suffix(pairs, t.part.select("p_partkey", "p_type"), left_on="l_partkey", right_on="p_partkey")
    per_type = refold(typed, "l_suppkey", "p_type", measures=("n",))
    sold = join_suffix(
        per_type, t.supplier.select("s_suppkey", "s_nationkey"), left_on="l_suppkey", right_on="s_suppkey"
    )
    named = join_suffix(
        refold(sold, "s_nationkey", "p_type", measures=("n",)),
        t.nation,
        left_on="s_nationkey",
        right_on="n_nationkey",
    )
    counted = refold(named, "n_name", "p_type", measures=("n",))
    best = arg_first(["p_type", "n"], [-F.col("n"), F.col("p_type")], largest=False)
    return (
        counted.groupBy("n_name")
        .agg(best.alias("best"))
        .select("n_name", F.col("best.p_type").alias("top_type"), F.col("best.n").alias("line_count"))
    )


@query(
    "pip10_busiest_nation_per_region",
    f"""WITH per AS (SELECT r_name, n_name, count(*) AS n, sum({sql_money('c_acctbal')}) AS balance
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
          GROUP BY 1, 2)
        SELECT r_name, arg_min(n_name, (-n, n_name)) AS nation_most_customers, max(n) AS customer_count,
               {sql_sum('balance')} AS region_balance
        FROM per GROUP BY r_name""",
)
def pip10(t):
    per_nation = t.customer.groupBy("c_nationkey").agg(
        rows().alias("n"), F.sum(money("c_acctbal")).alias("balance")
    )
    named = with_region(
        t, join_suffix(per_nation, t.nation, left_on="c_nationkey", right_on="n_nationkey")
    )
    best = arg_first(["n_name", "n"], [-F.col("n"), F.col("n_name")], largest=False)
    return (
        named.groupBy("r_name")
        .agg(best.alias("best"), sum_dp("balance").alias("region_balance"))
        .select(
            "r_name",
            F.col("best.n_name").alias("nation_most_customers"),
            F.col("best.n").alias("customer_count"),
            "region_balance",
        )
    )


@query(
    "pip11_supplier_pairs_sharing_orders",
    """WITH members AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)
       SELECT a.s AS supplier_a, b.s AS supplier_b, count(*) AS orders_together
       FROM members a JOIN members b ON a.o = b.o AND a.s < b.s
       GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5""",
)
def pip11(t):
    return top_pairs(
        t.lineitem, "l_orderkey", "l_suppkey", 5, ("supplier_a", "supplier_b", "orders_together")
    )


@query(
    "pip12_order_value_class",
    f"""SELECT *, CASE WHEN total_rev > 150000 THEN 'high_value' WHEN total_rev > 50000 THEN 'medium'
                       ELSE 'low' END AS value_class
        FROM (SELECT l_orderkey, {sql_sum(SQL_REVENUE)} AS total_rev, count(*) AS n_lines,
                     {sql_mean(sql_money('l_discount'), 3)} AS avg_disc
              FROM lineitem GROUP BY l_orderkey)""",
)
def pip12(t):
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        sum_dp(revenue()).alias("total_rev"),
        rows().alias("n_lines"),
        mean_dp(money("l_discount"), 3).alias("avg_disc"),
    )
    value_class = (
        F.when(F.col("total_rev") > 150000, F.lit("high_value"))
        .when(F.col("total_rev") > 50000, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return per_order.withColumn("value_class", value_class)


_PIVOT_CELLS = ", ".join(
    f"""coalesce({sql_mean(f"CASE WHEN c_mktsegment = '{s}' THEN " + sql_money('c_acctbal') + " END", 2)}, 0)
        AS "{s}" """
    for s in SEGMENTS
)


@query(
    "pip13_pivot_mean_balance",
    f"""SELECT n_name, {_PIVOT_CELLS} FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def pip13(t):
    placed = join_suffix(t.customer, t.nation, left_on="c_nationkey", right_on="n_nationkey")
    return pivot_sorted(
        placed, "n_name", "c_mktsegment", SEGMENTS, mean_dp(money("c_acctbal"), 2), fill=0.0
    )


@query(
    "pip14_brands_by_mean_price_and_count",
    f"""SELECT * FROM (SELECT p_brand AS brand, count(*) AS line_count,
               {sql_round(f"CAST(sum({sql_money('l_extendedprice')}) AS DOUBLE) / count(*) / 1000", 2)}
                 AS avg_thousands
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
        WHERE avg_thousands > 24.2 AND line_count > 2200 ORDER BY avg_thousands DESC""",
)
def pip14(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(
        F.sum(money("l_extendedprice")).alias("price"), rows().alias("n")
    )
    branded = join_suffix(
        per_part, t.part.select("p_partkey", "p_brand"), left_on="l_partkey", right_on="p_partkey"
    )
    per_brand = branded.groupBy(F.col("p_brand").alias("brand")).agg(
        F.sum("n").alias("line_count"),
        round_dp(ratio(ratio(amount(F.sum("price")), F.sum("n")), F.lit(1000)), 2).alias("avg_thousands"),
    )
    kept = per_brand.where((F.col("avg_thousands") > 24.2) & (F.col("line_count") > 2200))
    return kept.orderBy(F.desc("avg_thousands"), "brand")


@query(
    "pip15_customer_nations_per_supplier_nation",
    """SELECT src.n_name AS supplier_nation, count(DISTINCT dst.n_name) AS customer_nations
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation src ON s_nationkey = src.n_nationkey
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation dst ON c_nationkey = dst.n_nationkey
       GROUP BY 1 ORDER BY 2 DESC""",
)
def pip15(t):
    # Only the pair of nations counts, so duplicates are dropped before each join.
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    suppliers = t.supplier.select("s_suppkey", "s_nationkey")
    sent = join_suffix(lines, suppliers, left_on="l_suppkey", right_on="s_suppkey")
    per_order = sent.select("l_orderkey", "s_nationkey").distinct()
    orders = t.orders.select("o_orderkey", "o_custkey")
    per_customer_ = with_orders(per_order, orders).select("o_custkey", "s_nationkey").distinct()
    customers = t.customer.select("c_custkey", "c_nationkey")
    placed = join_suffix(per_customer_, customers, left_on="o_custkey", right_on="c_custkey")
    sources = join_suffix(
        placed.select("s_nationkey", "c_nationkey").distinct(),
        t.nation.select("n_nationkey", "n_name"),
        left_on="s_nationkey",
        right_on="n_nationkey",
    )
    both = join_suffix(
        sources,
        t.nation.select("n_nationkey", "n_name"),
        left_on="c_nationkey",
        right_on="n_nationkey",
        suffix="_dst",
    )
    return (
        both.groupBy(F.col("n_name").alias("supplier_nation"))
        .agg(n_unique("n_name_dst").alias("customer_nations"))
        .orderBy(F.desc("customer_nations"), "supplier_nation")
    )
