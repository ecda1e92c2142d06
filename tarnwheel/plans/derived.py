"""Evaluation tables derived from the driver tables, in Spark and in SQL.

Suppliers play the teams, customers the users, orders the submissions and order
lines the answers, so all of them grow with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwheel.functions import iso_date, slug
from tarnwheel.operators.results import first_wins
from tarnwheel.sources.store import conform

MEMBERS_PER_TEAM = 20
ANSWER_ORDER = ["received", "l_partkey", "l_suppkey", "generation_seconds", "peak_ram_mb"]


def _div(c: str, n: int):
    return F.call_function("div", F.col(c), F.lit(n))


def users(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def teams(t):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_suppkey") % 1000).cast("int"))
    return t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        slug("s_name").alias("slug"),
        day.cast("string").alias("created_at"),
    )


def members(t):
    role = F.when(F.col("c_custkey") % MEMBERS_PER_TEAM == 0, "owner").otherwise("member")
    return t.customer.select(
        _div("c_custkey", MEMBERS_PER_TEAM).alias("team_id"),
        F.col("c_custkey").alias("user_id"),
        role.alias("role"),
    )


def submissions(t):
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "global").otherwise("test")
    status = (
        F.when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "P", "failed")
        .when(F.col("o_orderpriority") == "5-LOW", "queued")
        .otherwise("running")
    )
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        _div("o_custkey", MEMBERS_PER_TEAM).alias("team_id"),
        F.col("o_custkey").alias("submitted_by_user_id"),
        kind.alias("kind"),
        status.alias("status"),
        F.when(F.col("o_totalprice") > 5000, F.col("o_totalprice")).alias("final_score"),
        iso_date("o_orderdate").alias("created_at"),
        iso_date("o_orderdate").alias("finished_at"),
    )


def attempts(t):
    """All answers with the attempt they belong to; a question may occur twice."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("submission_id"),
        F.concat(F.lit("Q"), F.col("l_linenumber").cast("string")).alias("question_id"),
        F.col("l_linenumber").cast("long").alias("index"),
        (F.year("l_shipdate") - 1994).cast("long").alias("attempt"),
        iso_date("l_shipdate").alias("received"),
        "l_partkey",
        "l_suppkey",
        (F.col("l_linestatus") == "F").alias("success"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("exact_match"),
        F.col("l_quantity").alias("generation_seconds"),
        (F.col("l_tax") * 100).alias("execution_seconds"),
        F.col("l_extendedprice").alias("peak_ram_mb"),
        (F.col("l_extendedprice") / 4).alias("peak_gpu_mb"),
    )


def answers(t):
    return first_wins(attempts(t), ["submission_id", "question_id"], ANSWER_ORDER)


def store_tables(t) -> dict:
    """The five tables of the store, with the answers of all attempts as results."""
    address = F.concat(slug("c_name"), F.lit("@example.org"))
    people = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), address.alias("email"))
    joined = F.lit("2020-01-01").alias("joined_at")
    sent = submissions(t).withColumn("repo_url", F.concat(F.lit("https://example.org/"), F.col("id").cast("string")))
    name = F.concat_ws("-", F.col("submission_id").cast("string"), "question_id")
    results = attempts(t).withColumns(
        {"id": name, "question_text": F.col("question_id"), "created_at": F.col("received")}
    )
    return {
        "user": conform(people, "user"),
        "team": conform(teams(t).withColumn("owner_id", F.col("id")), "team"),
        "team_member": conform(members(t).select("*", joined), "team_member"),
        "submission": conform(sent, "submission"),
        "benchmark_result": conform(results, "benchmark_result"),
    }


SQL_USERS = "users AS (SELECT c_custkey AS id, c_name AS name FROM customer)"
SQL_SLUG = (
    "substr(regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48)"
)
SQL_TEAMS = f"""teams AS (SELECT s_suppkey AS id, s_name AS name, {SQL_SLUG.format('s_name')} AS slug,
    strftime(DATE '2020-01-01' + CAST(s_suppkey % 1000 AS INTEGER), '%Y-%m-%d') AS created_at FROM supplier)"""
SQL_MEMBERS = f"""members AS (SELECT c_custkey // {MEMBERS_PER_TEAM} AS team_id, c_custkey AS user_id,
    CASE WHEN c_custkey % {MEMBERS_PER_TEAM} = 0 THEN 'owner' ELSE 'member' END AS role FROM customer)"""
SQL_SUBMISSIONS = f"""submissions AS (SELECT o_orderkey AS id, o_custkey // {MEMBERS_PER_TEAM} AS team_id,
    o_custkey AS submitted_by_user_id,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'global' ELSE 'test' END AS kind,
    CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'failed'
         WHEN o_orderpriority = '5-LOW' THEN 'queued' ELSE 'running' END AS status,
    CASE WHEN o_totalprice > 5000 THEN o_totalprice END AS final_score,
    strftime(o_orderdate, '%Y-%m-%d') AS created_at, strftime(o_orderdate, '%Y-%m-%d') AS finished_at
    FROM orders)"""
SQL_ATTEMPTS = """attempts AS (SELECT l_orderkey AS submission_id, 'Q' || l_linenumber AS question_id,
    CAST(l_linenumber AS BIGINT) AS index, year(l_shipdate) - 1994 AS attempt,
    strftime(l_shipdate, '%Y-%m-%d') AS received, l_partkey, l_suppkey,
    l_linestatus = 'F' AS success, CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS exact_match,
    l_quantity AS generation_seconds, l_tax * 100 AS execution_seconds, l_extendedprice AS peak_ram_mb,
    l_extendedprice / 4 AS peak_gpu_mb FROM lineitem)"""
SQL_ANSWERS = f"""{SQL_ATTEMPTS}, answers AS (SELECT * FROM attempts
    QUALIFY row_number() OVER (PARTITION BY submission_id, question_id ORDER BY {', '.join(ANSWER_ORDER)}) = 1)"""
