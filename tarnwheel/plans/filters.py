"""FIL01–FIL15: predicates over whole rows.

Dates are output as ISO text.  The predicates are written on the stored columns,
so that the scan can use them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwheel.functions import in_year, iso_dates
from tarnwheel.functions.temporal import ntz
from tarnwheel.operators import join_suffix

from .catalogue import query, sql_date

SQL_LINE = f"""l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
    l_tax, l_returnflag, l_linestatus, {sql_date('l_shipdate')} AS l_shipdate"""
SQL_ORDER = f"""o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    {sql_date('o_orderdate')} AS o_orderdate, o_orderpriority"""


@query("fil01_large_parts", "SELECT *, p_size > 45 AS large FROM part WHERE p_size > 45")
def fil01(t):
    return t.part.withColumn("large", F.col("p_size") > 45).where("large")


@query("fil02_promo_parts", "SELECT * FROM part WHERE p_type = 'PROMO'")
def fil02(t):
    return t.part.where(F.col("p_type") == "PROMO")


@query("fil03_building_customers", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def fil03(t):
    return t.customer.where(F.col("c_mktsegment") == "BUILDING")


@query(
    "fil04_indebted_customers",
    """SELECT *, c_acctbal < 0 AS indebted FROM customer
       WHERE c_acctbal < 0 AND c_nationkey > 10""",
)
def fil04(t):
    flagged = t.customer.withColumn("indebted", F.col("c_acctbal") < 0)
    return flagged.where(F.col("indebted") & (F.col("c_nationkey") > 10))


@query(
    "fil05_open_lines_tax_below_discount",
    f"""SELECT {SQL_LINE} FROM lineitem
        WHERE l_extendedprice > 50000 AND NOT (l_linestatus = 'F') AND l_tax < l_discount""",
)
def fil05(t):
    finished = F.col("l_linestatus") == "F"
    return iso_dates(
        t.lineitem.where(
            (F.col("l_extendedprice") > 50000) & ~finished & (F.col("l_tax") < F.col("l_discount"))
        )
    )


@query(
    "fil06_parts_by_size_price_type",
    """SELECT * FROM part
       WHERE p_size > 40 AND p_retailprice < 950 AND p_type IN ('PROMO', 'ECONOMY')""",
)
def fil06(t):
    return t.part.where(
        (F.col("p_size") > 40)
        & (F.col("p_retailprice") < 950)
        & F.col("p_type").isin("PROMO", "ECONOMY")
    )


@query(
    "fil07_discounted_lines",
    f"""SELECT {SQL_LINE} FROM lineitem
        WHERE l_returnflag IN ('A', 'R') AND l_discount > 0.05 AND l_quantity > 30""",
)
def fil07(t):
    return iso_dates(
        t.lineitem.where(
            F.col("l_returnflag").isin("A", "R")
            & (F.col("l_discount") > 0.05)
            & (F.col("l_quantity") > 30)
        )
    )


@query(
    "fil08_untaxed_lines",
    f"""SELECT {SQL_LINE} FROM lineitem WHERE l_quantity > 30 AND nullif(l_tax, 0) IS NULL""",
)
def fil08(t):
    return iso_dates(
        t.lineitem.where((F.col("l_quantity") > 30) & F.nullif(F.col("l_tax"), F.lit(0.0)).isNull())
    )


def _orders_with_lines(t):
    """Orders left-joined to one row per ordered key, so a hot order stays one row."""
    keys = t.lineitem.select("l_orderkey").distinct().withColumn("line_orderkey", F.col("l_orderkey"))
    return join_suffix(t.orders, keys, left_on="o_orderkey", right_on="l_orderkey", how="left")


@query(
    "fil09_orders_without_lines",
    f"""SELECT {SQL_ORDER} FROM orders
        LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey
        WHERE l_orderkey IS NULL""",
)
def fil09(t):
    return iso_dates(_orders_with_lines(t).where(F.col("line_orderkey").isNull()).drop("line_orderkey"))


@query(
    "fil10_early_orders_without_lines",
    f"""SELECT {SQL_ORDER} FROM orders
        LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey
        WHERE l_orderkey IS NULL AND o_orderdate < TIMESTAMP '1998-06-01'""",
)
def fil10(t):
    early = F.col("o_orderdate") < ntz("1998-06-01")
    return iso_dates(
        _orders_with_lines(t).where(F.col("line_orderkey").isNull() & early).drop("line_orderkey")
    )


@query(
    "fil11_forecast_revenue_lines",
    f"""SELECT {SQL_LINE} FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
          AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def fil11(t):
    return iso_dates(
        t.lineitem.where(
            in_year("l_shipdate", 1997) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)
        )
    )


@query(
    "fil12_taxed_lines",
    f"""SELECT {SQL_LINE} FROM lineitem
        WHERE nullif(l_tax, 0) IS NOT NULL AND l_tax > 0.02 AND l_quantity > 15
          AND l_extendedprice < 35000""",
)
def fil12(t):
    return iso_dates(
        t.lineitem.where(
            F.nullif(F.col("l_tax"), F.lit(0.0)).isNotNull()
            & (F.col("l_tax") > 0.02)
            & (F.col("l_quantity") > 15)
            & (F.col("l_extendedprice") < 35000)
        )
    )


@query(
    "fil13_european_nations",
    """SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation
       JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""",
)
def fil13(t):
    nations = join_suffix(t.nation, t.region, left_on="n_regionkey", right_on="r_regionkey")
    return nations.where(F.col("r_name") == "EUROPE")


@query(
    "fil14_valued_events",
    """SELECT event_id, user_id, event_type, value FROM events
       WHERE event_type IN ('click', 'purchase', 'signup') AND nullif(value, 0.01) IS NOT NULL""",
)
def fil14(t):
    return t.events.where(
        F.col("event_type").isin("click", "purchase", "signup")
        & F.nullif(F.col("value"), F.lit(0.01)).isNotNull()
    ).select("event_id", "user_id", "event_type", "value")


@query(
    "fil15_large_orders_of_1997",
    f"""SELECT {SQL_ORDER} FROM orders
        WHERE strftime(o_orderdate, '%Y') = '1997' AND o_totalprice > 100000""",
)
def fil15(t):
    return iso_dates(t.orders.where(in_year("o_orderdate", 1997) & (F.col("o_totalprice") > 100000)))
