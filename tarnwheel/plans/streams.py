"""Event-record queries: the events table is written as records and streamed back.

Clicks and views are answers, signups status messages, purchases ends of runs
and errors failures.  Clicks are delivered twice, as a source that retries does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwheel.functions import round_dp
from tarnwheel.operators.results import first_wins
from tarnwheel.operators.scoring import summarise
from tarnwheel.session import scratch_path
from tarnwheel.sources.records import ANSWER, format_record, parse_records, read_records, write_records
from tarnwheel.streaming import (
    aggregate_stream,
    final_rows,
    latest_rows,
    route_stream,
    statuses,
    stream_session,
)
from tarnwheel.streaming.jobs import answers_of
from tarnwheel.streaming.state import state_statuses, state_stream, state_summary, state_tables

from . import derived as d
from .catalogue import query, sql_round

KINDS = {"click": "question_result", "view": "question_result", "signup": "status", "purchase": "done"}


def event_records(t):
    """The events as one text column ``value`` without the closing blank line."""
    kind = F.lit("error")
    for event_type, name in KINDS.items():
        kind = F.when(F.col("event_type") == event_type, name).otherwise(kind)
    is_answer = F.col("event_type").isin("click", "view")
    generated = F.struct(
        F.lit("code").alias("code"),
        F.col("value").alias("generation_duration_seconds"),
        (F.col("value") * 100).alias("peak_ram_mb"),
        (F.col("value") / 4).alias("peak_gpu_mb"),
    )
    executed = F.struct(
        F.lit(True).alias("success"),
        (F.col("event_id") % 3 == 0).alias("exact_match"),
        (F.col("value") / 2).alias("execution_duration_seconds"),
    )
    payload = F.struct(
        F.col("user_id").alias("submission_id"),
        F.col("event_id").alias("seq"),
        F.when(is_answer, F.concat(F.lit("Q"), F.col("event_id").cast("string"))).alias("question_id"),
        F.when(kind == "status", F.lit("question_started")).alias("step"),
        F.when(kind == "error", F.col("props")).alias("message"),
        F.when(is_answer, generated).alias("generated_answer"),
        F.when(is_answer, executed).alias("executed_answer"),
    )
    copies = F.when(F.col("event_type") == "click", 2).otherwise(1)
    delivered = t.events.withColumn("delivery", F.explode(F.sequence(F.lit(1), copies)))
    return delivered.select(format_record(kind, payload).alias("value"))


SQL_EVENTS = """answers AS (SELECT user_id AS submission_id, event_id AS seq, event_id % 3 = 0 AS exact_match,
      value AS generation_seconds, value / 2 AS execution_seconds, value * 100 AS peak_ram_mb,
      value / 4 AS peak_gpu_mb FROM events WHERE event_type IN ('click', 'view')),
    summary AS (SELECT submission_id, count(*) AS completed, count(*) FILTER (WHERE exact_match) AS exact_matches,
      CAST(sum(CAST(generation_seconds AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS avg_generation_seconds,
      CAST(sum(CAST(execution_seconds AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS avg_execution_seconds,
      max(peak_ram_mb) AS peak_ram_mb, max(peak_gpu_mb) AS peak_gpu_mb FROM answers GROUP BY submission_id),
    ends AS (SELECT user_id AS submission_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS done,
      max(event_id) FILTER (WHERE event_type NOT IN ('click', 'view', 'signup', 'purchase')) AS failed,
      arg_max(substr(coalesce(props, 'Backend error'), 1, 2000), event_id)
        FILTER (WHERE event_type NOT IN ('click', 'view', 'signup', 'purchase')) AS message
      FROM events GROUP BY user_id),
    state AS (SELECT submission_id, CASE WHEN done IS NULL AND failed IS NULL THEN 'running'
        WHEN failed IS NULL OR done > failed THEN 'done' ELSE 'failed' END AS status,
      CASE WHEN failed IS NOT NULL AND NOT coalesce(done > failed, false) THEN message END AS error_message FROM ends)"""


def _written(t) -> str:
    """The records in a new folder of the shared storage."""
    folder = scratch_path(t.spark, "records")
    write_records(event_records(t), f"{folder}/in")
    return folder


@query(
    "s12_parse_event_records",
    """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'question_result' WHEN event_type = 'signup'
              THEN 'status' WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END AS event,
              event_id AS seq, user_id AS submission_id FROM events
       UNION ALL SELECT 'question_result', event_id, user_id FROM events WHERE event_type = 'click'""",
)
def s12(t):
    folder = _written(t)
    parsed = parse_records(read_records(t.spark, f"{folder}/in"))
    return parsed.select("event", "data.seq", "data.submission_id")


_SQL_ANSWER_RECORD = """',"question_id":"Q' || event_id || '","generated_answer":{"code":"code","generation_duration_seconds":'
    || value || ',"peak_ram_mb":' || value * 100 || ',"peak_gpu_mb":' || value / 4
    || '},"executed_answer":{"success":true,"exact_match":' || (event_id % 3 = 0) || ',"execution_duration_seconds":'
    || value / 2 || '}'"""


@query(
    "s13_format_event_records",
    f"""WITH named AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'question_result' WHEN event_type = 'signup'
            THEN 'status' WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END AS event FROM events),
          delivered AS (SELECT * FROM named UNION ALL SELECT * FROM named WHERE event_type = 'click')
        SELECT 'event: ' || event || chr(10) || 'data: {{"submission_id":' || user_id || ',"seq":' || event_id
          || CASE event WHEN 'question_result' THEN {_SQL_ANSWER_RECORD} WHEN 'status' THEN ',"step":"question_started"'
             WHEN 'error' THEN coalesce(',"message":' || to_json(props), '') ELSE '' END || '}}' AS value FROM delivered""",
)
def s13(t):
    return event_records(t)


def _streamed_totals(t):
    folder = _written(t)
    stream = aggregate_stream(
        stream_session(t.spark), f"{folder}/in", f"{folder}/out", f"{folder}/state"
    )
    stream.awaitTermination()
    return latest_rows(t.spark, f"{folder}/out")


def _routed(t):
    folder = _written(t)
    stream = route_stream(
        stream_session(t.spark), f"{folder}/in", f"{folder}/out", f"{folder}/state"
    )
    stream.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query("x01_streaming_aggregates", f"WITH {SQL_EVENTS} SELECT * FROM summary")
def x01(t):
    return _streamed_totals(t)


@query(
    "x02_route_events",
    """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'question_result' WHEN event_type = 'signup'
              THEN 'status' WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END AS event,
              CAST(sum(CASE WHEN event_type = 'click' THEN 2 ELSE 1 END) AS BIGINT) AS records,
              count(DISTINCT user_id) AS submissions
       FROM events GROUP BY 1""",
)
def x02(t):
    return _routed(t).groupBy(F.col("event").cast("string").alias("event")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("data.submission_id").alias("submissions")
    )


@query("x03_submission_status", f"WITH {SQL_EVENTS} SELECT * FROM state")
def x03(t):
    return statuses(parse_records(event_records(t), ANSWER))


SQL_FINAL_ROWS = f"""WITH {SQL_EVENTS}, scored AS (SELECT *, CAST(exact_matches AS DOUBLE) / completed AS accuracy FROM summary)
        SELECT submission_id, completed, exact_matches, {sql_round("accuracy", 6)} AS accuracy,
          {sql_round('''accuracy * 70 + 30 * (0.6::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE,
            1 - (avg_generation_seconds + avg_execution_seconds - 2) / 58))
            + 0.4::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE,
            1 - (greatest(peak_ram_mb, peak_gpu_mb) - 4096) / 36864)))''', 4)} AS composite_score
        FROM scored JOIN state USING (submission_id) WHERE status = 'done'"""


@query("x07_final_rows", SQL_FINAL_ROWS)
def x07(t):
    parsed = parse_records(event_records(t), ANSWER)
    answers = first_wins(answers_of(parsed), ["submission_id", "question_id"], ["seq"])
    rows = final_rows(summarise(answers, "submission_id"), statuses(parsed))
    return _scored(rows)


def _scored(rows):
    return rows.select(
        "submission_id",
        "completed",
        "exact_matches",
        round_dp("accuracy", 6).alias("accuracy"),
        round_dp("composite_score", 4).alias("composite_score"),
    )


# The same results from a state that a stream keeps, in several batches -----------


BATCHES = 2


def _kept_state(records, spark):
    """Write the records to files, take these in two batches, and read the state that they leave.

    Neighbours go to different files, so repeated records meet in different batches or files; a task
    that writes deals its own rows, however many there are.  Records repeat their names, so their files are packed.
    """
    folder = scratch_path(spark, "records")
    dealt = records.withColumn("deal", F.monotonically_increasing_id() % BATCHES)
    write_records(dealt, f"{folder}/in", "deal", packed=True)
    files = len(read_records(spark, f"{folder}/in/*").inputFiles())
    stream = state_stream(
        stream_session(spark), f"{folder}/in/*", f"{folder}/state", f"{folder}/offsets", max(1, -(-files // BATCHES))
    )
    stream.awaitTermination()
    return state_tables(spark, f"{folder}/state")


@query("x03_submission_status_streamed", f"WITH {SQL_EVENTS} SELECT * FROM state")
def x03_streamed(t):
    return state_statuses(_kept_state(event_records(t), t.spark)[1])


def attempt_records(t):
    """The answers of all attempts as records; a question may be answered more than once in an attempt."""
    rows = d.attempts(t)
    generated = F.struct(
        F.col("generation_seconds").alias("generation_duration_seconds"), "peak_ram_mb", "peak_gpu_mb"
    )
    executed = F.struct("success", "exact_match", F.col("execution_seconds").alias("execution_duration_seconds"))
    payload = F.struct(
        "submission_id",
        F.col("l_partkey").alias("seq"),
        "attempt",
        "question_id",
        generated.alias("generated_answer"),
        executed.alias("executed_answer"),
    )
    return rows.select(format_record(F.lit("question_result"), payload).alias("value"))


@query(
    "x06_latest_attempt_streamed",
    f"""WITH {d.SQL_ATTEMPTS}
        SELECT submission_id, attempt, question_id, l_partkey AS seq, coalesce(success AND exact_match, false) AS correct,
          generation_seconds, peak_ram_mb
        FROM (SELECT * FROM attempts QUALIFY attempt = max(attempt) OVER (PARTITION BY submission_id))
        QUALIFY row_number() OVER (PARTITION BY submission_id, question_id
          ORDER BY l_partkey, success NULLS FIRST, exact_match NULLS FIRST, generation_seconds NULLS FIRST,
            execution_seconds NULLS FIRST, peak_ram_mb NULLS FIRST) = 1""",
)
def x06_streamed(t):
    answers, _ = _kept_state(attempt_records(t), t.spark)
    correct = F.coalesce(F.col("first.success") & F.col("first.exact_match"), F.lit(False))
    first = [F.col(f"first.{c}").alias(c) for c in ("seq", "generation_seconds", "peak_ram_mb")]
    return answers.select("submission_id", "attempt", "question_id", correct.alias("correct"), *first)


@query("x07_final_rows_streamed", SQL_FINAL_ROWS)
def x07_streamed(t):
    answers, submissions = _kept_state(event_records(t), t.spark)
    return _scored(final_rows(state_summary(answers, submissions), state_statuses(submissions)))
