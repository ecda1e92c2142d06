"""Verification, scoring and result-store queries over derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.functions import digest16, iso_date, last_json_line, money, ntz, slug, sum_dp, to_datetime, whole_days
from tarnwheel.operators import running_sum
from tarnwheel.operators.canonical import MODULI, canonical_positions, ordered_digest
from tarnwheel.operators.closure import tree_totals
from tarnwheel.operators.fingerprint import (
    compare_runs,
    csv_lines,
    fingerprint,
    fingerprint_all,
    fingerprint_by,
    outcome,
    row_differences,
)
from tarnwheel.operators.results import first_wins, last_wins, latest_attempt
from tarnwheel.operators.scoring import final_scores, is_correct, peak_usage, summarise, with_scores
from tarnwheel.operators.store import (
    active_runs,
    leaderboard,
    progress,
    submission_details,
    submission_history,
    team_directory,
    team_members,
    visible_submissions,
)
from tarnwheel.session import scratch_path
from tarnwheel.sources.corpus import corpus_path, inline_table, load_questions, write_corpus
from tarnwheel.sources.store import key_violations
from tarnwheel.sources.tables import Tables, footer_session, open_registry, table_summary
from tarnwheel.streaming.progress import progress_records

from . import derived as d
from .catalogue import CATALOGUE, query, sql_money, sql_round, sql_sum

VIEWER = 7
TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


# Sources and sinks ---------------------------------------------------------


ORDERS_CSV = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.StringType()),
    ]
)


@query(
    "s02_csv_orders_by_year",
    f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n_orders,
               {sql_sum(sql_money('o_totalprice'))} AS total_price FROM orders GROUP BY 1""",
)
def s02(t):
    """The orders as CSV with text dates, opened by a registry with a schema, and their dates read from the text."""
    folder = scratch_path(t.spark, "csv")
    written = t.orders.select("o_orderkey", "o_totalprice", iso_date("o_orderdate").alias("o_orderdate"))
    written.write.option("header", True).csv(f"{folder}/orders")
    entries = {"orders_text": {"file_name": "orders", "format": "csv"}}
    orders = open_registry(t.spark, entries, root=folder, schemas={"orders_text": ORDERS_CSV}, views=False)["orders_text"]
    year = F.year(F.col("o_orderdate").cast("date")).alias("order_year")
    return orders.groupBy(year).agg(
        F.count(F.lit(1)).alias("n_orders"), sum_dp(money("o_totalprice")).alias("total_price")
    )


def _sql_keys(table: str, key: str, source: str, columns: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{key}' AS key_columns, count(*) FILTER (WHERE n > 1) AS repeated_keys,
        CAST(sum(n - 1) AS BIGINT) AS surplus_rows, CAST(0 AS BIGINT) AS incomplete_rows
        FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns})"""


@query(
    "s16_store_key_violations",
    " UNION ALL ".join(
        [
            _sql_keys("user", "id", "customer", "c_custkey"),
            _sql_keys("user", "email", "customer", d.SQL_SLUG.format("c_name")),
            _sql_keys("team", "id", "supplier", "s_suppkey"),
            _sql_keys("team", "name", "supplier", "s_name"),
            _sql_keys("team", "slug", "supplier", d.SQL_SLUG.format("s_name")),
            _sql_keys("team_member", "team_id,user_id", "customer", "c_custkey"),
            _sql_keys("team_member", "user_id", "customer", "c_custkey"),
            _sql_keys("submission", "id", "orders", "o_orderkey"),
            _sql_keys("benchmark_result", "id", "lineitem", "l_orderkey, l_linenumber"),
            _sql_keys("benchmark_result", "submission_id,question_id", "lineitem", "l_orderkey, l_linenumber"),
        ]
    ),
)
def s16(t):
    return key_violations(d.store_tables(t))


_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, count(*) AS row_count,
        (SELECT count(*) FROM information_schema.columns WHERE table_name = '{name}') AS column_count,
        CAST(1 AS BIGINT) AS table_count FROM {name}"""
    for name in TABLE_NAMES
)


@query(
    "s14_table_summary",
    f"""WITH counted AS ({_SUMMARY})
        SELECT * FROM counted UNION ALL
        SELECT 'TOTAL', CAST(sum(row_count) AS BIGINT), CAST(sum(column_count) AS BIGINT),
               CAST(sum(table_count) AS BIGINT) FROM counted""",
)
def s14(t):
    """All counts from the footers of the files, in a session of their own."""
    files = Tables(footer_session(t.spark), t.path)
    return table_summary({name: getattr(files, name) for name in TABLE_NAMES})


EVENTS_CSV = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.StringType())])


@query(
    "c06_text_to_datetime",
    """SELECT event_id, epoch_us(ts) AS micros, CAST(datediff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS days
       FROM events""",
)
def c06(t):
    """The times of the events as text in CSV files, read back as text and parsed."""
    path = scratch_path(t.spark, "times")
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")
    t.events.select("event_id", text).write.option("header", True).csv(path)
    events = open_registry(t.spark, {"times": {"file_name": path, "format": "csv"}}, schemas={"times": EVENTS_CSV}, views=False)
    moment = to_datetime("ts")
    return events["times"].select(
        "event_id",
        F.timestamp_diff("MICROSECOND", ntz("1970-01-01"), moment).alias("micros"),
        whole_days(moment, ntz("2024-01-01")).alias("days"),
    )


QUESTIONS_PER_FILE = 1000


@query(
    "s06_question_corpus",
    """SELECT CASE WHEN p_size % 2 = 0 THEN 'select' ELSE 'joins' END AS corpus, 'Q' || p_partkey AS id, p_name AS question,
              p_brand || ':part,Supplier:supplier.csv' AS datasets, p_type AS gold_code FROM part""",
)
def s06(t):
    """The parts as questions of two corpora, written as files, opened by name (one by default)."""
    root = scratch_path(t.spark, "corpora")
    registry = {"select": f"{root}/select", "joins": f"{root}/joins"}

    def entry(file_name, fmt):
        return F.struct(F.lit(file_name).alias("file_name"), F.lit(fmt).cast("string").alias("format"))

    questions = t.part.select(
        "p_size",
        "p_partkey",
        F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("question"),
        F.create_map("p_brand", entry("part", None), F.lit("Supplier"), entry("supplier", "csv")).alias("datasets"),
        F.col("p_type").alias("gold_code"),
    )
    bucket = F.call_function("div", F.col("p_partkey"), F.lit(QUESTIONS_PER_FILE))
    for rest, path in enumerate(registry.values()):
        write_corpus(questions.where(F.col("p_size") % 2 == rest), path, bucket)
    out = None
    for name in (None, "joins"):
        files = F.transform(
            F.map_entries("datasets"),
            lambda e: F.concat_ws(".", F.concat_ws(":", e["key"], e["value"]["file_name"]), e["value"]["format"]),
        )
        one = load_questions(t.spark, corpus_path(registry, name)).select(
            F.lit(name or "select").alias("corpus"), "id", "question", F.array_join(files, ",").alias("datasets"), "gold_code"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "s11_inline_tables",
    f"""WITH flags(flag, meaning) AS (VALUES ('A', 'accepted'), ('N', 'new'), ('R', 'returned')),
          states(state, closed) AS (VALUES ('F', 'yes'), ('O', NULL))
        SELECT meaning, closed, count(*) AS n_lines, {sql_sum(sql_money('l_extendedprice'))} AS price
        FROM lineitem JOIN flags ON l_returnflag = flag JOIN states ON l_linestatus = state GROUP BY ALL""",
)
def s11(t):
    """Two tables given in the program, as columns and as rows, joined to the lines."""
    flags = inline_table(
        t.spark, {"flag": ["A", "N", "R"], "meaning": ["accepted", "new", "returned"]}, "flag string, meaning string"
    )
    states = inline_table(t.spark, [{"state": "F", "closed": "yes"}, {"state": "O"}], "state string, closed string")
    sums = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_lines"), sum_dp(money("l_extendedprice")).alias("price")
    )
    named = sums.join(flags, F.col("l_returnflag") == F.col("flag")).join(states, F.col("l_linestatus") == F.col("state"))
    return named.select("meaning", "closed", "n_lines", "price")


@query(
    "s09_csv_rows",
    "SELECT o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',' || o_orderpriority AS line FROM orders",
)
def s09(t):
    return csv_lines(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    "s10_json_rows",
    """SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"'
              || o_orderstatus || '","o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS line
       FROM orders""",
)
def s10(t):
    orders = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate")
    )
    return orders.select(F.to_json(F.struct("*")).alias("line"))


# Scalar functions ----------------------------------------------------------


@query(
    "c09_row_digest",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              substr(sha256(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber), 1, 16)
                AS digest FROM lineitem""",
)
def c09(t):
    parts = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", digest16(parts).alias("digest")
    )


@query(
    "c12_last_json_line",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN l_returnflag <> 'R' THEN 'h' || l_partkey END AS hash FROM lineitem""",
)
def c12(t):
    text = F.concat(
        F.lit("loading tables\n\n"),
        F.when(F.col("l_returnflag") == "R", F.lit("Traceback {")).otherwise(
            F.concat(F.lit('{"hash": "h'), F.col("l_partkey").cast("string"), F.lit('"}'))
        ),
        F.lit("\n  \n"),
    )
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        last_json_line(text, "hash string")["hash"].alias("hash"),
    )


@query(
    "c13_slug",
    f"SELECT doc_id, {d.SQL_SLUG.format('source || text')} AS slug FROM documents",
)
def c13(t):
    return t.documents.select("doc_id", slug(F.concat("source", "text")).alias("slug"))


# Verification --------------------------------------------------------------


def _result_tables(t):
    """Two versions of one result per supplier; they differ for some suppliers."""
    grouped = t.lineitem.groupBy("l_suppkey", "l_partkey")
    gold = grouped.agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    wrong = F.when((F.col("l_quantity") == 50) & (F.col("l_tax") == 0.08) & (F.col("l_discount") > 0.07), 1)
    other = grouped.agg(
        F.sum(F.col("l_quantity").cast("long") + F.coalesce(wrong, F.lit(0))).alias("qty")
    )
    return other, gold


SQL_RESULT_TABLES = """gold AS (SELECT l_suppkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS qty
      FROM lineitem GROUP BY 1, 2),
    other AS (SELECT l_suppkey, l_partkey, CAST(sum(l_quantity + CASE WHEN l_quantity = 50 AND l_tax = 0.08
      AND l_discount > 0.07 THEN 1 ELSE 0 END) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2),
    judged AS (SELECT gold.l_suppkey AS question_id, bool_and(gold.qty = other.qty) AS same, count(*) AS n
      FROM gold JOIN other USING (l_suppkey, l_partkey) GROUP BY 1)"""


def _runs(results, failed):
    prints = fingerprint_by(results, "l_suppkey").withColumnRenamed("l_suppkey", "question_id")
    ok = F.col("question_id") % 10 != failed
    return prints.select(
        "question_id", ok.alias("ok"), *[F.when(ok, F.col(c)).alias(c) for c in ("columns", "shape", "hash")]
    )


def _compared(t):
    other, gold = _result_tables(t)
    return compare_runs(_runs(other, 3), _runs(gold, 5))


SQL_COMPARED = f"""{SQL_RESULT_TABLES}, compared AS (SELECT question_id,
      question_id % 10 NOT IN (3, 5) AS success,
      CASE WHEN question_id % 10 = 3 THEN false WHEN question_id % 10 = 5 THEN NULL ELSE same END AS exact_match,
      n FROM judged)"""


_LINE_CELLS = {
    **dict.fromkeys("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split(), ""),
    "l_returnflag": '"',
    "l_linestatus": '"',
    "l_shipdate": '"',
}
_LINE_TEXT = " || ',' || ".join(
    f"""'"{i}_{name}":{quote}' || """
    + (f"strftime({name}, '%Y-%m-%dT%H:%M:%S.000')" if name == "l_shipdate" else f"CAST({name} AS VARCHAR)")
    + (f" || '{quote}'" if quote else "")
    for i, (name, quote) in enumerate(_LINE_CELLS.items())
)
_LINE_COLUMNS = ",".join(_LINE_CELLS)


@query(
    "v02_fingerprint_of_lines",
    f"""WITH hashed AS (SELECT CAST('0x' || substr(sha256('{{{{' || {_LINE_TEXT} || '}}}}'), 1, 15) AS BIGINT) AS h FROM lineitem)
        SELECT string_split('{_LINE_COLUMNS}', ',') AS columns, count(*) AS rows, CAST(11 AS BIGINT) AS cols,
            substr(sha256('{_LINE_COLUMNS}|' || count(*) || '|' || coalesce(CAST(sum(h) AS VARCHAR), '')), 1, 16) AS hash
        FROM hashed""".replace("{{", "{").replace("}}", "}"),
)
def v02(t):
    """Columns, shape and hash of the largest table."""
    return fingerprint(t.lineitem).select(
        "columns", F.col("shape.rows").alias("rows"), F.col("shape.cols").alias("cols"), "hash"
    )


# Columns of the tables whose rows the twin can write as text: names, and quotes around the texts.
_DIGEST_TABLES = {
    "region": {"r_regionkey": "", "r_name": '"'},
    "nation": {"n_nationkey": "", "n_name": '"', "n_regionkey": ""},
    "customer": {"c_custkey": "", "c_name": '"', "c_nationkey": "", "c_acctbal": "", "c_mktsegment": '"'},
    "supplier": {"s_suppkey": "", "s_name": '"', "s_nationkey": "", "s_acctbal": ""},
    "part": {"p_partkey": "", "p_name": '"', "p_brand": '"', "p_type": '"', "p_size": "", "p_retailprice": ""},
    "lineitem": _LINE_CELLS,
    "labels": {"quality": "", "toxic": ""},
}


def _sql_row(cells: dict[str, str]) -> str:
    texts = {n: f"strftime({n}, '%Y-%m-%dT%H:%M:%S.000')" if n == "l_shipdate" else f"CAST({n} AS VARCHAR)" for n in cells}
    return " || ',' || ".join(
        f"""'"{i}_{n}":' || coalesce('{q}' || {texts[n]} || '{q}', 'null')""" for i, (n, q) in enumerate(cells.items())
    )


def _sql_digest(table: str, cells: dict[str, str]) -> str:
    """Horner's rule over the sorted rows, the last one first."""
    names, columns = ", ".join(cells), ",".join(cells)
    order = ", ".join(f"{n} DESC NULLS LAST" for n in cells)
    folded = " || '|' || ".join(
        f"list_reduce([0] || list(h % {p} ORDER BY {order}), lambda a, b: (a * {r} + b) % {p})" for p, r in MODULI
    )
    return f"""SELECT '{table}' AS table_name, CAST(sum(n) AS BIGINT) AS rows, CAST({len(cells)} AS BIGINT) AS cols,
        substr(sha256('{columns}|' || CAST(sum(n) AS BIGINT) || '|' || {folded}), 1, 16) AS hash
        FROM (SELECT *, CAST('0x' || substr(sha256('{{' || {_sql_row(cells)} || '}}*' || n), 1, 15) AS BIGINT) AS h
              FROM (SELECT {names}, count(*) AS n FROM {table} GROUP BY ALL))"""


@query("v02_ordered_digest", " UNION ALL ".join(_sql_digest(*item) for item in _DIGEST_TABLES.items()))
def v02_ordered(t):
    """Digests of the sorted rows; the labels without their key are nearly all copies of a few rows."""
    out = None
    for name, cells in _DIGEST_TABLES.items():
        one = ordered_digest(getattr(t, name).select(*cells)).select(
            F.lit(name).alias("table_name"), F.col("shape.rows").alias("rows"), F.col("shape.cols").alias("cols"), "hash"
        )
        out = one if out is None else out.unionByName(one)
    return out


_ORDERED = "l_returnflag, l_linestatus, l_discount, l_tax, l_quantity"


@query(
    "o04_canonical_order",
    f"SELECT {_ORDERED}, row_number() OVER (ORDER BY {_ORDERED}) - 1 AS position FROM lineitem",
)
def o04(t):
    """Lines in the order of all their columns; many are copies of one another."""
    return canonical_positions(t.lineitem.select(*_ORDERED.split(", ")))


@query(
    "v01_result_must_be_a_table",
    " UNION ALL ".join(
        [
            f"""SELECT '{name}' AS question_id, true AS ok, '{",".join(_DIGEST_TABLES[name])}' AS columns,
                count(*) AS rows, CAST({len(_DIGEST_TABLES[name])} AS BIGINT) AS cols FROM {name}"""
            for name in ("customer", "lineitem", "part")
        ]
        + ["SELECT 'names', false, NULL, NULL, NULL", "SELECT 'number', false, NULL, NULL, NULL"]
    ),
)
def v01(t):
    """Results of questions; those that are no table are failed runs."""
    results = {name: getattr(t, name) for name in ("customer", "lineitem", "part")}
    results |= {"number": len(t.orders.columns), "names": t.orders.columns}
    return fingerprint_all(results).select(
        "question_id",
        "ok",
        F.array_join("columns", ",").alias("columns"),
        F.col("shape.rows").alias("rows"),
        F.col("shape.cols").alias("cols"),
    )


@query(
    "v03_shape_per_question",
    f"WITH {SQL_RESULT_TABLES} SELECT question_id, n AS rows, CAST(2 AS BIGINT) AS cols FROM judged",
)
def v03(t):
    _, gold = _result_tables(t)
    return fingerprint_by(gold, "l_suppkey").select(
        F.col("l_suppkey").alias("question_id"),
        F.col("shape.rows").alias("rows"),
        F.col("shape.cols").alias("cols"),
    )


@query(
    "v04_compare_runs",
    f"WITH {SQL_COMPARED} SELECT question_id, success, CAST(exact_match AS VARCHAR) AS exact_match FROM compared",
)
def v04(t):
    return _compared(t).select("question_id", "success", F.col("exact_match").cast("string").alias("exact_match"))


@query(
    "v05_outcomes",
    f"""WITH {SQL_COMPARED} SELECT question_id, CASE WHEN success AND exact_match THEN 'OK'
        WHEN success THEN 'WRONG' ELSE 'FAIL' END AS outcome FROM compared""",
)
def v05(t):
    return _compared(t).select("question_id", outcome(F.col("success"), F.col("exact_match")).alias("outcome"))


@query(
    "v04_row_differences",
    f"""WITH {SQL_RESULT_TABLES},
        diff AS (SELECT 'missing' AS side, * FROM (SELECT * FROM gold EXCEPT ALL SELECT * FROM other)
          UNION ALL SELECT 'extra', * FROM (SELECT * FROM other EXCEPT ALL SELECT * FROM gold))
        SELECT l_suppkey, l_partkey, qty, side FROM diff""",
)
def v04_rows(t):
    return row_differences(*_result_tables(t))


@query(
    "v06_correct_so_far",
    f"""WITH {d.SQL_ANSWERS} SELECT submission_id, index,
        CAST(sum(CASE WHEN success AND exact_match THEN 1 ELSE 0 END)
          OVER (PARTITION BY submission_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS correct_so_far
        FROM answers""",
)
def v06(t):
    counted = running_sum(
        d.answers(t),
        is_correct().cast("long"),
        ["submission_id"],
        ["index"],
        "correct_so_far",
    )
    return counted.select("submission_id", "index", "correct_so_far")


# Scoring -------------------------------------------------------------------


@query(
    "v07_peak_usage_per_question",
    """SELECT l_orderkey AS submission_id, l_linenumber AS question, max(l_extendedprice) AS peak_ram_mb,
              max(l_extendedprice / 4) AS peak_gpu_mb FROM lineitem GROUP BY 1, 2""",
)
def v07(t):
    samples = t.lineitem.select(
        F.col("l_orderkey").alias("submission_id"),
        F.col("l_linenumber").alias("question"),
        F.col("l_extendedprice").alias("ram_mb"),
        (F.col("l_extendedprice") / 4).alias("gpu_mb"),
    )
    return peak_usage(samples, "submission_id", "question")


@query(
    "v08_memory_of_process_trees",
    """WITH RECURSIVE processes AS (SELECT c_custkey AS pid, c_custkey // 5 AS ppid,
           CAST(round(abs(c_acctbal)) AS BIGINT) AS rss_kb FROM customer),
       tree AS (SELECT pid AS root, pid FROM processes WHERE ppid = 0 AND pid <> 0
           UNION SELECT root, p.pid FROM tree JOIN processes p ON p.ppid = tree.pid AND p.pid <> p.ppid)
       SELECT root, count(*) AS processes, CAST(sum(rss_kb) AS DOUBLE) / 1024 AS ram_mb
       FROM tree JOIN processes USING (pid) GROUP BY root""",
)
def v08(t):
    processes = t.customer.select(
        F.col("c_custkey").alias("pid"),
        F.call_function("div", F.col("c_custkey"), F.lit(5)).alias("ppid"),
        F.round(F.abs("c_acctbal")).cast("long").alias("rss_kb"),
    )
    roots = processes.where((F.col("ppid") == 0) & (F.col("pid") != 0)).select(F.col("pid").alias("root"))
    return tree_totals(processes, roots)


@query(
    "v09_final_score",
    f"""WITH {d.SQL_ANSWERS}, totals AS (SELECT submission_id,
           count(*) FILTER (WHERE success AND exact_match) AS correct,
           CAST(sum(CAST(generation_seconds AS DECIMAL(20,6))) AS DOUBLE) AS seconds,
           CAST(sum(CAST(peak_gpu_mb AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS gpu,
           CAST(sum(CAST(peak_ram_mb AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS ram
         FROM answers GROUP BY submission_id)
        SELECT submission_id, correct, CASE WHEN correct = 0 THEN 0.0 ELSE
          {sql_round("correct / (greatest(seconds, 1e-6) * pow(greatest(gpu, 1e-6), 0.1) * pow(greatest(ram, 1e-6), 0.01))", 6)}
          END AS final_score FROM totals""",
)
def v09(t):
    return final_scores(d.answers(t), "submission_id")


_SUMMARY_SQL = """summary AS (SELECT submission_id, count(*) AS completed,
       count(*) FILTER (WHERE exact_match) AS exact_matches,
       CAST(sum(CAST(generation_seconds AS DECIMAL(20,6))) AS DOUBLE) / count(generation_seconds)
         AS avg_generation_seconds,
       CAST(sum(CAST(execution_seconds AS DECIMAL(20,6))) AS DOUBLE) / count(execution_seconds)
         AS avg_execution_seconds,
       max(peak_ram_mb) AS peak_ram_mb, max(peak_gpu_mb) AS peak_gpu_mb
     FROM answers GROUP BY submission_id)"""

_COMPOSITE_SQL = sql_round(
    """CAST(exact_matches AS DOUBLE) / greatest(completed, 1) * 70 + 30 * (0.6::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE,
         1 - (coalesce(avg_generation_seconds, 60) + coalesce(avg_execution_seconds, 10) - 2) / 58))
       + 0.4::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (greatest(coalesce(peak_ram_mb, 0), coalesce(peak_gpu_mb, 0)) - 4096) / 36864)))""",
    6,
)


@query(
    "v10_composite_score",
    f"""WITH {d.SQL_ANSWERS}, {_SUMMARY_SQL}
        SELECT submission_id, {_COMPOSITE_SQL} AS composite_score FROM summary""",
)
def v10(t):
    scored = with_scores(summarise(d.answers(t), "submission_id"))
    return scored.select("submission_id", "composite_score")


@query(
    "v11_submission_aggregates",
    f"""WITH {d.SQL_ANSWERS}, {_SUMMARY_SQL}
        SELECT *, CAST(exact_matches AS DOUBLE) / greatest(completed, 1) AS accuracy FROM summary""",
)
def v11(t):
    return with_scores(summarise(d.answers(t), "submission_id")).drop("composite_score")


# Result store --------------------------------------------------------------


@query(
    "l01_leaderboard",
    f"""WITH {d.SQL_TEAMS}, {d.SQL_SUBMISSIONS}, best AS (SELECT * FROM submissions
          WHERE kind = 'global' AND status = 'done' AND final_score IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY final_score DESC, finished_at, id) = 1)
        SELECT row_number() OVER (ORDER BY final_score DESC, finished_at, best.id) AS rank, team_id,
               teams.name AS team_name, teams.slug AS team_slug, best.id AS submission_id, final_score, finished_at
        FROM best JOIN teams ON teams.id = team_id""",
)
def l01(t):
    return leaderboard(d.submissions(t), d.teams(t))


@query(
    "l02_team_directory",
    f"""WITH {d.SQL_TEAMS}, {d.SQL_MEMBERS}
        SELECT id, name, slug, created_at, count(user_id) AS member_count
        FROM teams LEFT JOIN members ON team_id = id GROUP BY ALL""",
)
def l02(t):
    return team_directory(d.teams(t), d.members(t))


_HISTORY_SQL = f"""WITH {d.SQL_TEAMS}, {d.SQL_USERS}, {d.SQL_SUBMISSIONS},
    newest AS (SELECT * FROM submissions WHERE {{}} ORDER BY created_at DESC, id DESC LIMIT 200)
    SELECT newest.*, teams.name AS team_name, teams.slug AS team_slug, users.name AS user_name
    FROM newest JOIN teams ON teams.id = team_id LEFT JOIN users ON users.id = submitted_by_user_id"""


@query("l03_global_history", _HISTORY_SQL.format("kind = 'global'"))
def l03_global(t):
    return submission_history(d.submissions(t), d.teams(t), d.users(t), F.col("kind") == "global")


@query("l03_team_history", _HISTORY_SQL.format("team_id = 2"))
def l03_team(t):
    return submission_history(d.submissions(t), d.teams(t), d.users(t), F.col("team_id") == 2)


_VISIBLE_SQL = f"""{d.SQL_SUBMISSIONS}, {d.SQL_MEMBERS}, visible AS (SELECT submissions.*,
    team_id IN (SELECT team_id FROM members WHERE user_id = {VIEWER}) AS include_details FROM submissions
    WHERE kind = 'global' OR team_id IN (SELECT team_id FROM members WHERE user_id = {VIEWER}))"""


@query("l04_visible_submissions", f"WITH {_VISIBLE_SQL} SELECT id, team_id, kind, include_details FROM visible")
def l04(t):
    visible = visible_submissions(d.submissions(t), d.members(t), F.lit(VIEWER))
    return visible.select("id", "team_id", "kind", "include_details")


@query(
    "l04_submission_details",
    f"""WITH {_VISIBLE_SQL}, {d.SQL_ANSWERS} SELECT submission_id, question_id, success, generation_seconds
        FROM answers WHERE submission_id IN (SELECT id FROM visible WHERE include_details)""",
)
def l04_details(t):
    visible = visible_submissions(d.submissions(t), d.members(t), F.lit(VIEWER))
    rows = submission_details(visible, d.attempts(t))
    kept = first_wins(rows, ["submission_id", "question_id"], d.ANSWER_ORDER)
    return kept.select("submission_id", "question_id", "success", "generation_seconds")


@query(
    "l05_team_members",
    f"""WITH {d.SQL_TEAMS}, {d.SQL_MEMBERS}, {d.SQL_USERS}
        SELECT team_id, user_id, role, users.name FROM members
        JOIN teams ON teams.id = team_id JOIN users ON users.id = user_id
        WHERE slug = 'supplier-000000002'""",
)
def l05(t):
    return team_members(d.teams(t), d.members(t), d.users(t), F.lit("supplier-000000002"))


@query(
    "l06_progress",
    f"""WITH {d.SQL_ANSWERS} SELECT submission_id, max(index) AS total, count(*) AS completed,
        {sql_round("CAST(count(*) AS DOUBLE) / max(index) * 100", 6)} AS progress
        FROM answers GROUP BY submission_id""",
)
def l06(t):
    per = d.answers(t).groupBy("submission_id").agg(
        F.max("index").alias("total"), F.count(F.lit(1)).alias("completed")
    )
    shown = F.round(progress(F.col("completed"), F.col("total")).cast("decimal(38,9)"), 6).cast("double")
    return per.withColumn("progress", shown)


@query(
    "l07_active_runs",
    f"""WITH {d.SQL_SUBMISSIONS} SELECT team_id, active, active > 1 AS violation FROM
        (SELECT team_id, CAST(sum(CASE WHEN status IN ('queued', 'running') THEN 1 ELSE 0 END) AS BIGINT) AS active
         FROM submissions GROUP BY team_id)""",
)
def l07(t):
    return active_runs(d.submissions(t))


# Rules of the event stream, on batch tables -------------------------------


_ANSWER_COLUMNS = "submission_id, question_id, attempt, received, l_partkey, l_suppkey, success"


@query("x04_first_answer_wins", f"WITH {d.SQL_ANSWERS} SELECT {_ANSWER_COLUMNS} FROM answers")
def x04(t):
    return d.answers(t).select(*_ANSWER_COLUMNS.split(", "))


@query(
    "x05_last_answer_wins",
    f"""WITH {d.SQL_ATTEMPTS} SELECT {_ANSWER_COLUMNS} FROM attempts
        QUALIFY row_number() OVER (PARTITION BY submission_id, question_id
          ORDER BY received DESC, l_partkey DESC, l_suppkey DESC, generation_seconds DESC, peak_ram_mb DESC) = 1""",
)
def x05(t):
    kept = last_wins(d.attempts(t), ["submission_id", "question_id"], d.ANSWER_ORDER)
    return kept.select(*_ANSWER_COLUMNS.split(", "))


@query(
    "x06_latest_attempt",
    f"""WITH {d.SQL_ATTEMPTS} SELECT {_ANSWER_COLUMNS} FROM attempts
        QUALIFY attempt = max(attempt) OVER (PARTITION BY submission_id)""",
)
def x06(t):
    return latest_attempt(d.attempts(t), "submission_id").select(*_ANSWER_COLUMNS.split(", "))


@query(
    "x08_progress_records",
    f"""WITH {d.SQL_ANSWERS}, counted AS (SELECT submission_id, index,
          count(*) OVER (PARTITION BY submission_id) AS total,
          CAST(sum(CASE WHEN success AND exact_match THEN 1 ELSE 0 END)
            OVER (PARTITION BY submission_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS correct_so_far
          FROM answers)
        SELECT *, 'event: progress' || chr(10) || 'data: {{"step":"question_done","index":' || index || ',"total":'
          || total || ',"correct_so_far":' || correct_so_far || '}}' AS record FROM counted""",
)
def x08(t):
    return progress_records(d.answers(t))


__all__ = ["CATALOGUE"]
