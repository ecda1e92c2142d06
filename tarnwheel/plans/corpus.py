"""The 105 questions over the 59-table corpus, on its own tables.

``run(spark, "PIP02")`` expects the corpus tables as temp views, as
``sources.tables.open_registry`` binds them.  Most questions are SQL texts, which
also run on other engines; windows, pairs and the pivot use the operators of this
package, which split hot keys.  Measures are summed per key before the joins
where that removes rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.functions import amount, day_gap, mean_dp, money, ratio, revenue, round_dp
from tarnwheel.operators import (
    dense_rank_desc,
    group_totals,
    join_suffix,
    ordinal_rank,
    pivot_sorted,
    previous_value,
    rolling_mean,
    running_count,
    running_sum,
    top_pairs,
)

from .catalogue import sql_mean, sql_money, sql_round, sql_sum

# Day counts differ between SQL dialects; these two functions hide that.
SPARK_FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION whole_days(later STRING, earlier STRING) RETURNS BIGINT
       RETURN CAST(extract(DAY FROM CAST(later AS TIMESTAMP_NTZ) - CAST(earlier AS TIMESTAMP_NTZ)) AS BIGINT)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION day_gap(later STRING, earlier STRING) RETURNS BIGINT
       RETURN CAST(datediff(CAST(later AS DATE), CAST(earlier AS DATE)) AS BIGINT)""",
)


def _value(prefix: str = "", discount: bool = True) -> str:
    kept = f" * (1 - CAST({prefix}discount AS DECIMAL(4,2)))" if discount else ""
    return f"CAST({prefix}unit_price AS DECIMAL(18,2)) * CAST({prefix}quantity AS DECIMAL(10,0)){kept}"


LINE = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
PER_ORDER = f"(SELECT order_id, sum({_value()}) AS rev FROM nw_order_details GROUP BY order_id)"
PER_INVOICE = f"(SELECT invoice_id, sum({_value(discount=False)}) AS rev FROM ck_invoice_lines GROUP BY invoice_id)"
PER_TPCH_ORDER = f"(SELECT l_orderkey, sum({LINE}) AS rev FROM tpch_lineitem GROUP BY l_orderkey)"
RENTED = "sk_rentals JOIN sk_inventory USING (inventory_id)"


def _top(table: str, key: str, order: str) -> str:
    """First row per key."""
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS nth
                FROM {table}) AS numbered WHERE nth = 1)"""


SQL: dict[str, str] = {
    # Aggregations
    "AGG01": "SELECT category_id, count(*) AS count FROM nw_products GROUP BY category_id",
    "AGG02": "SELECT rating, count(*) AS count FROM sk_films GROUP BY rating",
    "AGG03": f"""SELECT {sql_sum(sql_money('l_quantity'))} AS total_qty,
                 {sql_sum(sql_money('l_extendedprice'))} AS total_price FROM tpch_lineitem""",
    "AGG04": f"SELECT order_id, {sql_sum(_value())} AS total_revenue FROM nw_order_details GROUP BY order_id",
    "AGG05": f"""SELECT staff_id, {sql_sum(sql_money('amount'))} AS total, {sql_mean(sql_money('amount'), 2)} AS avg
                 FROM sk_payments GROUP BY staff_id""",
    "AGG06": f"""SELECT l_returnflag, l_linestatus, {sql_sum(sql_money('l_quantity'))} AS sum_qty,
                 {sql_sum(sql_money('l_extendedprice'))} AS sum_price, {sql_mean(sql_money('l_discount'), 4)} AS avg_disc,
                 count(*) AS count_order FROM tpch_lineitem GROUP BY 1, 2 ORDER BY 1, 2""",
    "AGG07": f"""SELECT substr(invoice_date, 1, 4) AS year, count(*) AS invoice_count,
                 {sql_sum(sql_money('total'))} AS total_sales FROM ck_invoices GROUP BY 1 ORDER BY 1""",
    "AGG08": f"""SELECT product_id, {sql_sum(_value())} AS total_revenue FROM nw_order_details
                 GROUP BY product_id ORDER BY total_revenue DESC, product_id LIMIT 1""",
    "AGG09": "SELECT substr(rental_date, 1, 7) AS month, count(*) AS rental_count FROM sk_rentals GROUP BY 1 ORDER BY 1",
    "AGG10": """SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM tpch_orders
                GROUP BY 1, 2 ORDER BY 1, 2""",
    "AGG11": f"""SELECT continent, CAST(sum(population) AS BIGINT) AS total_pop,
                 {sql_mean(sql_money('life_expectancy'), 1)} AS avg_life_exp
                 FROM sp_world_country GROUP BY continent ORDER BY total_pop DESC""",
    "AGG12": f"SELECT cylinders, {sql_mean(sql_money('mpg'), 1)} AS avg_mpg FROM sp_car_data GROUP BY 1 ORDER BY 1",
    "AGG13": f"""SELECT min(n) AS min_orders, max(n) AS max_orders, {sql_mean('n', 1)} AS avg_orders
                 FROM (SELECT customer_id, count(*) AS n FROM nw_orders GROUP BY customer_id) AS per""",
    "AGG14": f"""SELECT genre_id, {sql_round('CAST(sum(bytes) AS DOUBLE) / 1e9', 2)} AS total_gb
                 FROM ck_tracks GROUP BY genre_id""",
    "AGG15": f"""SELECT rating, {sql_mean(sql_money('replacement_cost'), 2)} AS avg_replacement_cost,
                 {sql_round('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM sk_films) * 100', 1)} AS pct_of_total
                 FROM sk_films GROUP BY rating""",
    # Filters
    "FIL01": "SELECT * FROM nw_products WHERE discontinued",
    "FIL02": "SELECT * FROM sk_films WHERE rating = 'R'",
    "FIL03": "SELECT * FROM tpch_customer WHERE c_mktsegment = 'BUILDING'",
    "FIL04": "SELECT * FROM sp_singer WHERE is_male AND age > 30",
    "FIL05": "SELECT * FROM nw_products WHERE unit_price > 50 AND NOT discontinued AND units_in_stock < reorder_level",
    "FIL06": "SELECT * FROM sk_films WHERE length_min > 150 AND rental_rate < 2.99 AND rating IN ('PG', 'PG-13')",
    "FIL07": """SELECT * FROM tpch_lineitem
                WHERE l_shipmode IN ('RAIL', 'SHIP') AND l_discount > 0.05 AND l_quantity > 30""",
    "FIL08": "SELECT * FROM ck_tracks WHERE milliseconds > 300000 AND composer IS NULL",
    "FIL09": "SELECT * FROM nw_orders WHERE shipped_date IS NULL",
    "FIL10": "SELECT * FROM sk_rentals WHERE return_date IS NULL AND rental_date < '2024-06-01'",
    "FIL11": """SELECT * FROM tpch_lineitem WHERE l_shipdate >= '2023-01-01' AND l_shipdate <= '2023-12-31'
                AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "FIL12": """SELECT * FROM sp_car_data
                WHERE horsepower IS NOT NULL AND horsepower > 200 AND mpg > 15 AND weight < 3500""",
    "FIL13": "SELECT * FROM sp_world_country WHERE continent = 'Europe'",
    "FIL14": "SELECT * FROM nw_customers WHERE country IN ('France', 'Germany', 'Spain') AND fax IS NOT NULL",
    "FIL15": "SELECT * FROM ck_invoices WHERE invoice_date LIKE '2023%' AND total > 10",
    # Joins
    "JOI01": "SELECT product_name, category_name, unit_price FROM nw_products JOIN nw_categories USING (category_id)",
    "JOI02": "SELECT t.name, g.name AS genre_name FROM ck_tracks t JOIN ck_genres g ON t.genre_id = g.genre_id",
    "JOI03": "SELECT s_name, n_name, s_acctbal FROM tpch_supplier JOIN tpch_nation ON s_nationkey = n_nationkey",
    "JOI04": """SELECT order_id, company_name, order_date FROM nw_orders JOIN nw_customers USING (customer_id)
                WHERE country = 'Germany'""",
    "JOI05": """SELECT title, name, rating FROM sk_films JOIN sk_film_category USING (film_id)
                JOIN sk_categories USING (category_id)""",
    "JOI06": """SELECT name AS singer_name, concert_name, year FROM sp_performance
                JOIN sp_singer USING (singer_id) JOIN sp_concert USING (concert_id)""",
    "JOI07": """SELECT * FROM nw_customers c
                WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT customer_id FROM nw_orders) AS o
                                  WHERE o.customer_id = c.customer_id)""",
    "JOI08": """SELECT * FROM sp_singer s
                WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT singer_id FROM sp_performance) AS p
                                  WHERE p.singer_id = s.singer_id)""",
    "JOI09": f"""SELECT category_name, {sql_sum('rev')} AS total_revenue
                 FROM (SELECT product_id, sum({_value()}) AS rev FROM nw_order_details GROUP BY product_id) AS per
                 JOIN nw_products USING (product_id) JOIN nw_categories USING (category_id)
                 GROUP BY category_name ORDER BY total_revenue DESC""",
    "JOI10": f"""SELECT n_name, {sql_sum('spent')} AS total_value
                 FROM (SELECT o_custkey, sum({sql_money('o_totalprice')}) AS spent FROM tpch_orders GROUP BY 1) AS per
                 JOIN tpch_customer ON o_custkey = c_custkey JOIN tpch_nation ON c_nationkey = n_nationkey
                 GROUP BY n_name ORDER BY total_value DESC""",
    "JOI11": f"""SELECT title, rental_count FROM (SELECT film_id, count(*) AS rental_count FROM {RENTED}
                 GROUP BY film_id ORDER BY rental_count DESC, film_id LIMIT 1) AS best JOIN sk_films USING (film_id)""",
    "JOI12": """SELECT first_name, last_name, country FROM sk_customers JOIN sk_addresses USING (address_id)
                JOIN sk_cities USING (city_id) JOIN sk_countries USING (country_id)""",
    "JOI13": """SELECT g.name AS genre, CAST(sum(n) AS BIGINT) AS total_purchased
                FROM (SELECT track_id, sum(quantity) AS n FROM ck_invoice_lines GROUP BY track_id) AS per
                JOIN ck_tracks t ON per.track_id = t.track_id JOIN ck_genres g ON t.genre_id = g.genre_id
                GROUP BY g.name ORDER BY total_purchased DESC, genre LIMIT 1""",
    "JOI14": """SELECT e.first_name, e.last_name, m.first_name AS manager_first, m.last_name AS manager_last
                FROM nw_employees e JOIN nw_employees m ON e.reports_to = m.employee_id
                WHERE e.reports_to IS NOT NULL""",
    "JOI15": """SELECT airline_id, d.airport_name AS destination FROM sp_route
                JOIN sp_airport s ON src_airport_id = s.airport_id JOIN sp_airport d ON dst_airport_id = d.airport_id
                WHERE stops = 0 AND s.iata = 'CDG'""",
    # Full analyses
    "PIP01": f"""SELECT company_name, country, total_spent FROM (
                   SELECT customer_id, {sql_sum('order_rev')} AS total_spent FROM (
                     SELECT order_id, sum({_value('d.')}) AS order_rev FROM nw_order_details d
                     JOIN nw_products p ON d.product_id = p.product_id
                     JOIN nw_categories c ON p.category_id = c.category_id
                     WHERE category_name = 'Seafood' GROUP BY order_id) AS per
                   JOIN nw_orders USING (order_id)
                   GROUP BY customer_id ORDER BY total_spent DESC, customer_id LIMIT 5) AS best
                 JOIN nw_customers USING (customer_id)""",
    "PIP02": f"""SELECT n_name, {sql_sum('rev')} AS total_revenue FROM {PER_TPCH_ORDER} AS per
                 JOIN tpch_orders ON l_orderkey = o_orderkey JOIN tpch_customer ON o_custkey = c_custkey
                 JOIN tpch_nation ON c_nationkey = n_nationkey JOIN tpch_region ON n_regionkey = r_regionkey
                 WHERE r_name = 'EUROPE' GROUP BY n_name ORDER BY total_revenue DESC""",
    "PIP03": f"""SELECT c.name, count(*) AS rental_count FROM {RENTED} JOIN sk_films USING (film_id)
                 JOIN sk_film_category USING (film_id) JOIN sk_categories c USING (category_id)
                 GROUP BY c.name ORDER BY rental_count DESC, c.name LIMIT 1""",
    "PIP04": f"""SELECT c.first_name, c.last_name, {sql_sum('rev')} AS total_rev FROM {PER_INVOICE} AS per
                 JOIN ck_invoices i ON per.invoice_id = i.invoice_id
                 JOIN ck_customers c ON i.customer_id = c.customer_id
                 JOIN ck_employees e ON c.support_rep_id = e.employee_id
                 GROUP BY c.first_name, c.last_name
                 ORDER BY total_rev DESC, c.first_name, c.last_name LIMIT 1""",
    "PIP05": f"""SELECT month, monthly_rev,
                   {sql_round('(monthly_rev - before) / nullif(before, 0) * 100', 1)} AS growth_pct
                 FROM (SELECT month, monthly_rev, lag(monthly_rev) OVER (ORDER BY month) AS before FROM (
                   SELECT substr(order_date, 1, 7) AS month, {sql_sum('rev')} AS monthly_rev
                   FROM {PER_ORDER} AS per JOIN nw_orders USING (order_id)
                   WHERE order_date LIKE '2024%' GROUP BY 1) AS monthly) AS pairs""",
    "PIP06": f"""SELECT n_name, {sql_sum(sql_money('l_extendedprice'))} AS total_value FROM tpch_lineitem
                 JOIN tpch_part ON l_partkey = p_partkey JOIN tpch_supplier ON l_suppkey = s_suppkey
                 JOIN tpch_nation ON s_nationkey = n_nationkey WHERE p_type LIKE '%STANDARD%'
                 GROUP BY n_name ORDER BY total_value DESC, n_name LIMIT 3""",
    "PIP07": f"""SELECT country, {sql_sum('paid')} AS total_revenue
                 FROM (SELECT customer_id, sum({sql_money('amount')}) AS paid FROM sk_payments GROUP BY 1) AS per
                 JOIN sk_customers USING (customer_id) JOIN sk_addresses USING (address_id)
                 JOIN sk_cities USING (city_id) JOIN sk_countries USING (country_id)
                 GROUP BY country ORDER BY total_revenue DESC""",
    "PIP08": f"""SELECT customer_id, day_gap('2025-01-01', max(order_date)) AS recency,
                   count(DISTINCT order_id) AS frequency, {sql_sum('rev')} AS monetary
                 FROM {PER_ORDER} AS per JOIN nw_orders USING (order_id)
                 GROUP BY customer_id ORDER BY monetary DESC""",
    "PIP09": f"""WITH counted AS (SELECT r.name AS artist_name, g.name AS genre_name, count(*) AS n
                   FROM ck_tracks t JOIN ck_albums a ON t.album_id = a.album_id
                   JOIN ck_artists r ON a.artist_id = r.artist_id JOIN ck_genres g ON t.genre_id = g.genre_id
                   GROUP BY 1, 2)
                 SELECT artist_name, genre_name AS top_genre, n AS track_count
                 FROM {_top('counted', 'artist_name', 'n DESC, genre_name')} AS best""",
    "PIP10": f"""WITH joined AS (SELECT continent, name, n_cities, population
                   FROM (SELECT country_code, count(*) AS n_cities FROM sp_world_city GROUP BY 1) AS per
                   JOIN sp_world_country ON country_code = code)
                 SELECT b.continent, b.name AS country_most_cities, b.n_cities AS city_count, s.continent_pop
                 FROM {_top('joined', 'continent', 'n_cities DESC, name')} AS b
                 JOIN (SELECT continent, CAST(sum(population) AS BIGINT) AS continent_pop FROM joined GROUP BY 1) AS s
                   ON b.continent = s.continent""",
    "PIP12": f"""SELECT *, CASE WHEN total_rev > 10000 THEN 'high_value' WHEN total_rev > 1000 THEN 'medium'
                   ELSE 'low' END AS value_class
                 FROM (SELECT l_orderkey, {sql_sum(LINE)} AS total_rev, count(*) AS n_lines,
                   {sql_mean(sql_money('l_discount'), 3)} AS avg_disc FROM tpch_lineitem GROUP BY 1) AS per""",
    "PIP14": f"""SELECT * FROM (SELECT r.name AS artist, count(*) AS track_count,
                   {sql_round('CAST(sum(milliseconds) AS DOUBLE) / count(milliseconds) / 60000', 2)} AS avg_duration_min
                   FROM ck_tracks t JOIN ck_albums a ON t.album_id = a.album_id
                   JOIN ck_artists r ON a.artist_id = r.artist_id GROUP BY r.name) AS per
                 WHERE avg_duration_min > 5 AND track_count > 10 ORDER BY avg_duration_min DESC""",
    "PIP15": """SELECT a.country AS airline_country, count(DISTINCT p.country) AS destinations_countries
                FROM sp_route r JOIN sp_airline a ON r.airline_id = a.airline_id
                JOIN sp_airport p ON r.dst_airport_id = p.airport_id
                GROUP BY a.country ORDER BY destinations_countries DESC""",
    # Final set
    "OPT01": "SELECT product_name, unit_price FROM nw_products WHERE unit_price > 100",
    "OPT02": "SELECT rating, count(*) AS count FROM sk_films GROUP BY rating",
    "OPT03": "SELECT c_name, c_acctbal FROM tpch_customer WHERE c_acctbal < 0",
    "OPT04": "SELECT name, milliseconds FROM ck_tracks WHERE milliseconds < 60000",
    "OPT05": "SELECT name, population FROM sp_world_country WHERE continent = 'Asia'",
    "OPT06": """SELECT product_name, category_name FROM nw_products JOIN nw_categories USING (category_id)
                WHERE unit_price < 20""",
    "OPT07": """SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS order_count
                FROM (SELECT o_custkey, count(*) AS n FROM tpch_orders GROUP BY 1) AS per
                JOIN tpch_customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "OPT08": f"""SELECT customer_id, {sql_sum(sql_money('amount'))} AS total FROM sk_payments
                 WHERE amount > 5 GROUP BY customer_id""",
    "OPT09": f"""SELECT product_id, {sql_sum(_value())} AS total_revenue FROM nw_order_details
                 GROUP BY product_id ORDER BY total_revenue DESC""",
    "OPT10": f"""SELECT * FROM (SELECT g.name AS genre,
                   {sql_round('CAST(sum(milliseconds) AS DOUBLE) / count(milliseconds) / 1000', 1)} AS avg_seconds,
                   count(*) AS n_tracks FROM ck_tracks t JOIN ck_genres g ON t.genre_id = g.genre_id
                   GROUP BY g.name) AS per WHERE n_tracks > 50""",
    "OPT11": f"""SELECT category_name, {sql_sum(_value('d.'))} AS total_revenue FROM nw_order_details d
                 JOIN nw_products p ON d.product_id = p.product_id
                 JOIN nw_categories c ON p.category_id = c.category_id
                 JOIN nw_orders o ON d.order_id = o.order_id WHERE order_date LIKE '2024%'
                 GROUP BY category_name ORDER BY total_revenue DESC""",
    "OPT12": f"""SELECT n_name, {sql_sum('rev')} AS total_rev FROM {PER_TPCH_ORDER} AS per
                 JOIN tpch_orders ON l_orderkey = o_orderkey JOIN tpch_customer ON o_custkey = c_custkey
                 JOIN tpch_nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'
                 GROUP BY n_name ORDER BY total_rev DESC""",
    "OPT13": f"""SELECT c.name, count(*) AS rental_count FROM {RENTED} JOIN sk_films USING (film_id)
                 JOIN sk_film_category USING (film_id) JOIN sk_categories c USING (category_id)
                 WHERE rental_date LIKE '2024%' GROUP BY c.name ORDER BY rental_count DESC""",
    "OPT14": f"""SELECT r.name, {sql_sum('rev')} AS total_sales
                 FROM (SELECT track_id, sum({_value(discount=False)}) AS rev FROM ck_invoice_lines GROUP BY 1) AS per
                 JOIN ck_tracks t ON per.track_id = t.track_id JOIN ck_albums a ON t.album_id = a.album_id
                 JOIN ck_artists r ON a.artist_id = r.artist_id GROUP BY r.name ORDER BY total_sales DESC""",
    "OPT15": f"""SELECT country, {sql_mean(sql_money('freight'), 2)} AS avg_freight FROM nw_orders
                 JOIN nw_customers USING (customer_id) WHERE shipped_date IS NOT NULL
                 GROUP BY country ORDER BY avg_freight DESC, country LIMIT 5""",
    "OPT16": f"""SELECT p_container, {sql_sum('rev')} AS total_rev
                 FROM (SELECT l_partkey, sum({LINE}) AS rev FROM tpch_lineitem GROUP BY 1) AS per
                 JOIN tpch_part ON l_partkey = p_partkey WHERE p_size < 10
                 GROUP BY p_container ORDER BY total_rev DESC""",
    "OPT17": f"""SELECT {sql_mean('whole_days(return_date, rental_date)', 1)} AS avg_rental_days
                 FROM {RENTED} JOIN sk_films USING (film_id) WHERE return_date IS NOT NULL AND rating = 'R'""",
    "OPT18": f"""SELECT country, {sql_sum(_value('d.'))} AS total_rev FROM nw_order_details d
                 JOIN nw_orders o ON d.order_id = o.order_id JOIN nw_products p ON d.product_id = p.product_id
                 JOIN nw_suppliers s ON p.supplier_id = s.supplier_id WHERE order_date LIKE '2024%'
                 GROUP BY country ORDER BY total_rev DESC""",
    "OPT19": f"""SELECT c_name, {sql_sum('rev')} AS total_rev FROM {PER_TPCH_ORDER} AS per
                 JOIN tpch_orders ON l_orderkey = o_orderkey JOIN tpch_customer ON o_custkey = c_custkey
                 WHERE o_orderpriority = '1-URGENT' GROUP BY c_name ORDER BY total_rev DESC, c_name LIMIT 5""",
    "OPT20": f"""SELECT country, {sql_sum('rev')} AS total FROM {PER_INVOICE} AS per
                 JOIN ck_invoices i ON per.invoice_id = i.invoice_id
                 JOIN ck_customers c ON i.customer_id = c.customer_id WHERE invoice_date LIKE '2023%'
                 GROUP BY country ORDER BY total DESC""",
    "OPT22": f"""SELECT l_shipmode, {sql_mean(LINE, 2)} AS avg_rev, count(*) AS n_lines
                 FROM tpch_lineitem GROUP BY l_shipmode ORDER BY avg_rev DESC""",
    "OPT23": f"""SELECT substr(order_date, 1, 7) AS month, count(DISTINCT order_id) AS n_orders,
                   {sql_sum('rev')} AS total_rev FROM {PER_ORDER} AS per JOIN nw_orders USING (order_id)
                 WHERE order_date LIKE '2023%' GROUP BY 1 ORDER BY 1""",
    "OPT24": f"""SELECT country, {sql_mean(sql_money('mpg'), 1)} AS avg_mpg FROM sp_car_data
                 JOIN sp_car_maker ON maker_id = id WHERE cylinders = 6 GROUP BY country""",
    "OPT25": """SELECT name, count(*) AS route_count FROM sp_route r JOIN sp_airline a ON r.airline_id = a.airline_id
                WHERE active GROUP BY name ORDER BY route_count DESC""",
    "OPT26": f"""SELECT first_name, last_name, total_paid, n_rentals,
                   {sql_round('total_paid / nullif(n_rentals, 0)', 2)} AS avg_per_rental
                 FROM (SELECT customer_id, {sql_sum(sql_money('amount'))} AS total_paid FROM sk_payments
                       GROUP BY 1) AS paid
                 JOIN (SELECT customer_id, count(*) AS n_rentals FROM sk_rentals GROUP BY 1) AS rented
                   USING (customer_id)
                 JOIN sk_customers USING (customer_id) WHERE active ORDER BY total_paid DESC""",
    "OPT27": f"""SELECT ps_partkey, ps_suppkey AS best_supp, ps_supplycost AS min_cost, n_name
                 FROM {_top('tpch_partsupp', 'ps_partkey', 'ps_supplycost, ps_suppkey')} AS best
                 JOIN tpch_supplier ON ps_suppkey = s_suppkey JOIN tpch_nation ON s_nationkey = n_nationkey""",
    "OPT28": f"""SELECT first_name, last_name, total_rev FROM (
                   SELECT employee_id, {sql_sum('rev')} AS total_rev FROM {PER_ORDER} AS per
                   JOIN nw_orders USING (order_id) WHERE order_date LIKE '2023%'
                   GROUP BY employee_id ORDER BY total_rev DESC, employee_id LIMIT 5) AS best
                 JOIN nw_employees USING (employee_id)""",
    "OPT29": f"""SELECT r_name, {sql_sum(LINE)} AS total_rev FROM tpch_lineitem
                 JOIN tpch_part ON l_partkey = p_partkey JOIN tpch_supplier ON l_suppkey = s_suppkey
                 JOIN tpch_nation ON s_nationkey = n_nationkey JOIN tpch_region ON n_regionkey = r_regionkey
                 WHERE p_mfgr = 'Manufacturer#3' GROUP BY r_name ORDER BY total_rev DESC""",
    "OPT30": f"""SELECT first_name, last_name, avg_days, n_rentals, total_paid FROM (
                   SELECT customer_id, {sql_mean('whole_days(return_date, rental_date)', 1)} AS avg_days,
                     count(*) AS n_rentals FROM {RENTED} JOIN sk_films USING (film_id)
                   WHERE return_date IS NOT NULL AND rating = 'R' GROUP BY customer_id) AS rented
                 JOIN (SELECT customer_id, {sql_sum(sql_money('amount'))} AS total_paid FROM sk_payments
                       GROUP BY 1) AS paid USING (customer_id)
                 JOIN sk_customers USING (customer_id)
                 ORDER BY total_paid DESC, customer_id LIMIT 10""",
}

FRAMES: dict[str, tuple[Callable[[Callable[[str], DataFrame]], DataFrame], str]] = {}


def frame(name: str, sql: str):
    """Register a question that is built from operators, with its SQL twin."""

    def register(fn):
        FRAMES[name] = (fn, sql)
        return fn

    return register


def _dbl(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: amount(n).cast("double") for n in names})


def _running(value: str, key: str, order: str) -> str:
    return f"""CAST(sum({sql_money(value)}) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)
               AS DOUBLE)"""


@frame(
    "WIN01",
    """SELECT *, dense_rank() OVER (PARTITION BY order_id ORDER BY revenue DESC) AS rank_in_order
       FROM (SELECT *, CAST(CAST(unit_price AS DECIMAL(18,2)) * quantity AS DOUBLE) AS revenue FROM nw_order_details)""",
)
def win01(t):
    value = amount(revenue("unit_price", None, "quantity")).cast("double")
    lines = t("nw_order_details").withColumn("revenue", value)
    return dense_rank_desc(lines, "revenue", ["order_id"], "rank_in_order")


@frame("WIN02", f"SELECT *, {_running('amount', 'customer_id', 'payment_date, payment_id')} AS running_total FROM sk_payments")
def win02(t):
    order = ["payment_date", "payment_id"]
    return _dbl(running_sum(t("sk_payments"), money("amount"), ["customer_id"], order, "running_total"), "running_total")


@frame("WIN03", "SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS price_rank FROM tpch_orders")
def win03(t):
    return dense_rank_desc(t("tpch_orders"), "o_totalprice", ["o_custkey"], "price_rank")


@frame(
    "WIN04",
    """SELECT *, CAST(day_gap(order_date, lag(order_date) OVER (PARTITION BY customer_id
       ORDER BY order_date, order_id)) AS DOUBLE) AS days_since_prev FROM nw_orders""",
)
def win04(t):
    held = previous_value(t("nw_orders"), "order_date", ["customer_id"], ["order_date", "order_id"], "before")
    gap = day_gap(F.to_date("order_date"), F.to_date("before")).cast("double")
    return held.withColumn("days_since_prev", gap).drop("before")


@frame(
    "WIN05",
    f"""SELECT *, {sql_round(f"amount / nullif(CAST(sum({sql_money('amount')}) OVER (PARTITION BY customer_id) AS DOUBLE), 0) * 100", 2)}
        AS pct_of_total FROM sk_payments""",
)
def win05(t):
    held = group_totals(t("sk_payments"), ["customer_id"], total=F.sum(money("amount")))
    return held.withColumn("pct_of_total", round_dp(ratio("amount", amount("total")) * 100, 2)).drop("total")


@frame("WIN06", f"SELECT *, {_running('l_extendedprice', 'l_orderkey', 'l_linenumber')} AS cum_price FROM tpch_lineitem")
def win06(t):
    lines = t("tpch_lineitem")
    return _dbl(running_sum(lines, money("l_extendedprice"), ["l_orderkey"], ["l_linenumber"], "cum_price"), "cum_price")


@frame(
    "WIN07",
    """SELECT *, count(invoice_id) OVER (PARTITION BY customer_id ORDER BY invoice_date, invoice_id
       ROWS UNBOUNDED PRECEDING) AS invoice_number FROM ck_invoices""",
)
def win07(t):
    return running_count(t("ck_invoices"), "invoice_id", ["customer_id"], ["invoice_date", "invoice_id"], "invoice_number")


@frame(
    "WIN08",
    f"""SELECT *, {sql_round("quantity - CAST(sum(quantity) OVER w AS DOUBLE) / count(quantity) OVER w", 2)}
        AS qty_diff_from_avg FROM nw_order_details WINDOW w AS (PARTITION BY product_id)""",
)
def win08(t):
    held = group_totals(t("nw_order_details"), ["product_id"], total=F.sum("quantity"), n=F.count("quantity"))
    gap = round_dp(F.col("quantity") - ratio("total", "n"), 2)
    return held.withColumn("qty_diff_from_avg", gap).drop("total", "n")


@frame("WIN09", "SELECT *, rental_date = max(rental_date) OVER (PARTITION BY customer_id) AS is_latest FROM sk_rentals")
def win09(t):
    held = group_totals(t("sk_rentals"), ["customer_id"], last=F.max("rental_date"))
    return held.withColumn("is_latest", F.col("rental_date") == F.col("last")).drop("last")


@frame(
    "WIN10",
    f"""SELECT * EXCLUDE (r), {sql_round("CAST(r AS DOUBLE) / max(r) OVER (PARTITION BY o_custkey) * 100", 1)} AS pct_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM tpch_orders)""",
)
def win10(t):
    ranked = ordinal_rank(t("tpch_orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], "r")
    held = group_totals(ranked, ["o_custkey"], last=F.max("r"))
    return held.withColumn("pct_rank", round_dp(ratio("r", "last") * 100, 1)).drop("r", "last")


@frame("WIN11", "SELECT *, dense_rank() OVER (PARTITION BY country_code ORDER BY population DESC) AS pop_rank FROM sp_world_city")
def win11(t):
    return dense_rank_desc(t("sp_world_city"), "population", ["country_code"], "pop_rank")


@frame(
    "WIN12",
    f"""SELECT *, {sql_round(f"line_rev / nullif(CAST(sum({sql_money('line_rev')}) OVER (PARTITION BY invoice_id) AS DOUBLE), 0) * 100", 2)}
        AS pct_of_invoice FROM (SELECT *, CAST(CAST(unit_price AS DECIMAL(18,2)) * quantity AS DOUBLE) AS line_rev FROM ck_invoice_lines)""",
)
def win12(t):
    value = amount(revenue("unit_price", None, "quantity")).cast("double")
    lines = t("ck_invoice_lines").withColumn("line_rev", value)
    held = group_totals(lines, ["invoice_id"], total=F.sum(money("line_rev")))
    return held.withColumn("pct_of_invoice", round_dp(ratio("line_rev", amount("total")) * 100, 2)).drop("total")


@frame(
    "WIN13",
    f"""SELECT *, {sql_round(f"(unit_price - CAST(sum({sql_money('unit_price')}) OVER w AS DOUBLE) / count(*) OVER w) / nullif(stddev_samp(unit_price) OVER w, 0)", 2)}
        AS price_zscore FROM nw_products WINDOW w AS (PARTITION BY category_id)""",
)
def win13(t):
    held = group_totals(
        t("nw_products"),
        ["category_id"],
        total=F.sum(money("unit_price")),
        n=F.count("unit_price"),
        spread=F.stddev_samp("unit_price"),
    )
    score = round_dp(ratio(F.col("unit_price") - ratio(amount("total"), "n"), "spread"), 2)
    return held.withColumn("price_zscore", score).drop("total", "n", "spread")


@frame(
    "WIN14",
    f"""SELECT *, CASE WHEN count(amount) OVER w = 3 THEN
        {sql_round(f"CAST(sum({sql_money('amount')}) OVER w AS DOUBLE) / 3", 6)} END AS rolling_avg_3 FROM sk_payments
        WINDOW w AS (PARTITION BY staff_id ORDER BY payment_date, payment_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def win14(t):
    order = ["payment_date", "payment_id"]
    rolled = rolling_mean(t("sk_payments"), money("amount"), ["staff_id"], order, 3, "rolling_avg_3", amount)
    return rolled.withColumn("rolling_avg_3", round_dp("rolling_avg_3", 6))


@frame("WIN15", f"SELECT *, {_running('l_extendedprice', 'l_suppkey', 'l_shipdate, l_orderkey, l_linenumber')} AS cum_revenue FROM tpch_lineitem")
def win15(t):
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return _dbl(running_sum(t("tpch_lineitem"), money("l_extendedprice"), ["l_suppkey"], order, "cum_revenue"), "cum_revenue")


@frame(
    "PIP11",
    """SELECT a.actor_id, b.actor_id AS actor_id_b, count(*) AS films_together FROM sk_film_actor a
       JOIN sk_film_actor b ON a.film_id = b.film_id AND a.actor_id < b.actor_id
       GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5""",
)
def pip11(t):
    return top_pairs(t("sk_film_actor"), "film_id", "actor_id", 5, ("actor_id", "actor_id_b", "films_together"))


@frame(
    "PIP13",
    f"""PIVOT (SELECT country, category_name, {sql_mean(sql_money('unit_price'), 2)} AS price FROM nw_products
        JOIN nw_suppliers USING (supplier_id) JOIN nw_categories USING (category_id) GROUP BY 1, 2)
        ON category_name USING coalesce(max(price), 0) GROUP BY country""",
)
def pip13(t):
    joined = join_suffix(t("nw_products"), t("nw_suppliers"), "supplier_id")
    joined = join_suffix(joined, t("nw_categories"), "category_id")
    return pivot_sorted(joined, "country", "category_name", None, mean_dp(money("unit_price"), 2), fill=0.0)


@frame(
    "OPT21",
    f"""SELECT *, dense_rank() OVER (ORDER BY customer_total DESC) AS customer_rank FROM (
        SELECT *, {_running('amount', 'customer_id', 'payment_date, payment_id')} AS running_total,
          CAST(sum({sql_money('amount')}) OVER (PARTITION BY customer_id) AS DOUBLE) AS customer_total FROM sk_payments)""",
)
def opt21(t):
    order = ["payment_date", "payment_id"]
    summed = running_sum(t("sk_payments"), money("amount"), ["customer_id"], order, "running_total")
    totals = t("sk_payments").groupBy("customer_id").agg(F.sum(money("amount")).alias("customer_total"))
    ranked = dense_rank_desc(totals, "customer_total", [], "customer_rank").withColumnRenamed("customer_id", "customer")
    held = summed.join(ranked, F.col("customer_id").eqNullSafe(F.col("customer"))).drop("customer")
    return _dbl(held, "running_total", "customer_total")


def questions() -> list[str]:
    return sorted([*SQL, *FRAMES])


def run(spark: SparkSession, name: str) -> DataFrame:
    """Answer one question over the temp views of the session."""
    if name in FRAMES:
        return FRAMES[name][0](spark.table)
    for function in SPARK_FUNCTIONS:
        spark.sql(function)
    return spark.sql(SQL[name])
