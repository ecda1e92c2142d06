"""Registries, the query corpus, event records and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tarnwheel.operators.scoring import summarise
from tarnwheel.sources.corpus import corpus_path, load_questions, open_question
from tarnwheel.sources.records import format_record, parse_records, read_records, stream_records, write_records
from tarnwheel.sources.tables import open_registry, read_table, resolve, table_summary, write_table
from tarnwheel.streaming import aggregate_stream, final_rows, latest_rows, progress_records, route_stream, statuses
from tarnwheel.streaming.jobs import answers_of


def test_resolve():
    assert resolve("data/a.parquet", "/root") == "/root/data/a.parquet"
    assert resolve("/abs/a.parquet", "/root") == "/abs/a.parquet"
    assert resolve("s3a://b/a.parquet", "/root") == "s3a://b/a.parquet"


def test_registry_formats_and_summary(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    write_table(df, f"{tmp_path}/p.parquet")
    df.write.option("header", True).csv(f"{tmp_path}/c.csv")
    tables = open_registry(
        spark,
        {"p_table": {"file_name": "p.parquet"}, "c_table": {"file_name": "c.csv", "format": "csv"}},
        root=str(tmp_path),
        schemas={"c_table": df.schema},
    )
    assert tables["c_table"].schema == df.schema
    assert spark.sql("SELECT count(*) AS n FROM p_table JOIN c_table USING (k)").first()["n"] == 2
    got = {r["table_name"]: (r["row_count"], r["table_count"]) for r in table_summary(tables).collect()}
    assert got == {"c_table": (2, 1), "p_table": (2, 1), "TOTAL": (4, 2)}
    assert read_table(spark, f"{tmp_path}/c.csv", "csv").columns == ["k", "v"]


def test_corpus(spark, tmp_path):
    write_table(spark.range(4).withColumnRenamed("id", "k"), f"{tmp_path}/t.parquet")
    text = {
        "questions": [
            {"id": "Q1", "question": "How many?", "datasets": {"t": {"file_name": "t.parquet", "format": "parquet"}},
             "gold_code": "result = t"},
            {"id": "Q2", "question": "Which?", "datasets": {"u": {"file_name": "t.parquet"}}, "gold_code": "result = u"},
        ]
    }
    (tmp_path / "select.json").write_text(json.dumps(text, indent=1))
    registry = {"select": f"{tmp_path}/select.json"}
    questions = load_questions(spark, corpus_path(registry))
    got = {r["id"]: r for r in questions.collect()}
    assert got["Q2"]["datasets"]["u"]["file_name"] == "t.parquet"
    tables = open_question(spark, got["Q1"], root=str(tmp_path))
    assert tables["t"].count() == 4
    with pytest.raises(ValueError, match="select"):
        corpus_path(registry, "unknown")


RECORDS = """event: status
data: {"submission_id": 1, "seq": 1, "step": "cloning"}

: heartbeat

data: {"submission_id": 1, "seq": 2}

event: question_result
data: {"submission_id": 1, "seq": 3,
data:  "question_id": "Q1"}

event:error
data: not json {

event: nothing

event: error
data: {"submission_id": 2, "seq": 1, "message": "boom"}

"""


def test_parse_records(spark, tmp_path):
    (tmp_path / "r.txt").write_text(RECORDS)
    parsed = parse_records(read_records(spark, str(tmp_path))).select(
        "event", "raw", "data.submission_id", "data.seq", "data.question_id"
    )
    got = sorted(tuple(r) for r in parsed.select("event", "submission_id", "seq", "question_id").fillna(-1).collect())
    assert got == [
        ("error", -1, -1, None),
        ("error", 2, 1, None),
        ("message", 1, 2, None),
        ("question_result", 1, 3, "Q1"),
        ("status", 1, 1, None),
    ]
    assert parsed.where("seq IS NULL").first()["raw"] == "not json {"


def test_records_round_trip(spark, tmp_path):
    rows = spark.range(20).select(
        format_record(F.lit("status"), F.struct(F.col("id").alias("submission_id"), F.lit("a\nb").alias("message"))).alias("value")
    )
    write_records(rows, f"{tmp_path}/out")
    parsed = parse_records(read_records(spark, f"{tmp_path}/out"))
    assert parsed.count() == 20
    assert parsed.select("data.message").distinct().collect()[0][0] == "a\nb"


def answer(submission, question, seq, seconds, match):
    body = {
        "submission_id": submission,
        "seq": seq,
        "question_id": question,
        "generated_answer": {"generation_duration_seconds": seconds, "peak_ram_mb": 100.0 * seq, "peak_gpu_mb": 1.0},
        "executed_answer": {"success": True, "exact_match": match, "execution_duration_seconds": 0.5},
    }
    return f"event: question_result\ndata: {json.dumps(body)}\n\n"


@pytest.fixture
def feed(tmp_path):
    """Three files; the second repeats a record of the first, the third ends run 1."""
    folder = tmp_path / "in"
    folder.mkdir()
    first = answer(1, "Q1", 1, 1.5, True) + answer(1, "Q2", 2, 2.5, False) + answer(2, "Q1", 1, 4.0, None)
    second = answer(1, "Q1", 1, 1.5, True) * 3 + answer(2, "Q2", 2, 6.0, True)
    third = 'event: done\ndata: {"submission_id": 1, "seq": 9}\n\n' + answer(2, "Q3", 3, 8.0, True)
    third += 'event: error\ndata: {"submission_id": 2, "seq": 10, "message": "%s"}\n\n' % ("x" * 3000)
    for name, text in (("a", first), ("b", second), ("c", third)):
        (folder / name).write_text(text)
    return folder


def test_stream_equals_batch(spark, tmp_path, feed):
    stream = aggregate_stream(spark, str(feed), f"{tmp_path}/out", f"{tmp_path}/state", files_per_batch=1)
    stream.awaitTermination()
    parsed = parse_records(read_records(spark, str(feed)))
    batch = summarise(answers_of(parsed).dropDuplicates(["submission_id", "question_id"]), "submission_id")
    streamed = latest_rows(spark, f"{tmp_path}/out").select(*batch.columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert {r["submission_id"]: (r["completed"], r["exact_matches"]) for r in streamed.collect()} == {1: (2, 1), 2: (3, 2)}


def test_stream_resumes_where_it_stopped(spark, tmp_path, feed):
    held = (feed / "c").read_text()
    (feed / "c").unlink()
    arguments = (spark, str(feed), f"{tmp_path}/out", f"{tmp_path}/state")
    aggregate_stream(*arguments).awaitTermination()
    before = {r["submission_id"]: r["completed"] for r in latest_rows(spark, f"{tmp_path}/out").collect()}
    (feed / "c").write_text(held)
    aggregate_stream(*arguments).awaitTermination()
    after = {r["submission_id"]: r["completed"] for r in latest_rows(spark, f"{tmp_path}/out").collect()}
    assert (before, after) == ({1: 2, 2: 2}, {1: 2, 2: 3})


def test_routing_status_and_final_row(spark, tmp_path, feed):
    route_stream(spark, str(feed), f"{tmp_path}/routed", f"{tmp_path}/rstate").awaitTermination()
    routed = spark.read.parquet(f"{tmp_path}/routed")
    assert {r["event"]: r["count"] for r in routed.groupBy("event").count().collect()} == {
        "question_result": 8,
        "done": 1,
        "error": 1,
    }
    state = statuses(routed)
    got = {r["submission_id"]: (r["status"], r["error_message"]) for r in state.collect()}
    assert got == {1: ("done", None), 2: ("failed", "x" * 2000)}
    answers = answers_of(routed).dropDuplicates(["submission_id", "question_id"])
    (row,) = final_rows(summarise(answers, "submission_id"), state).collect()
    latency = 0.6 * (1 - (2.0 + 0.5 - 2) / 58)
    assert (row["submission_id"], row["accuracy"]) == (1, 0.5)
    assert row["composite_score"] == pytest.approx(35 + 30 * (latency + 0.4), abs=1e-6)


def test_streamed_text_is_split_like_batch(spark, feed):
    assert stream_records(spark, str(feed)).isStreaming


def test_progress_records(spark):
    data = [(1, 1, True, True), (1, 2, True, None), (1, 3, True, True), (2, 1, False, True)]
    answers = spark.createDataFrame(data, "submission_id long, index long, success boolean, exact_match boolean")
    got = sorted((r["submission_id"], r["index"], r["total"], r["correct_so_far"]) for r in progress_records(answers).collect())
    assert got == [(1, 1, 3, 1), (1, 2, 3, 1), (1, 3, 3, 2), (2, 1, 1, 0)]
    first = progress_records(answers).where("submission_id = 2").first()["record"]
    assert first == 'event: progress\ndata: {"step":"question_done","index":1,"total":1,"correct_so_far":0}'


def test_only_done_and_error_decide_a_status(spark):
    from tarnwheel.streaming.progress import statuses

    kinds = {
        1: ["question_result", "done", "status", "question_result"],
        2: ["done", "error", "status"],
        3: ["error", "done", "question_result"],
        4: ["status", "question_result"],
        5: ["error"],
    }
    rows = [(k, (i, n, "boom" if k == "error" else None)) for i, ks in kinds.items() for n, k in enumerate(ks)]
    parsed = spark.createDataFrame(
        rows, "event string, data struct<submission_id: long, seq: long, message: string>"
    )
    got = {r["submission_id"]: (r["status"], r["error_message"]) for r in statuses(parsed).collect()}
    assert got == {
        1: ("done", None),
        2: ("failed", "boom"),
        3: ("done", None),
        4: ("running", None),
        5: ("failed", "boom"),
    }


def test_store_tables_take_their_schema(spark):
    from tarnwheel.sources.store import KEYS, conform, key_violations, store_schema

    rows = spark.createDataFrame([(1, 7, "u", "x"), (1, 8, None, "x")], "id long, team_id long, submitted_by_user_id string, more string")
    rows = rows.withColumns({"repo_url": F.lit("r"), "kind": F.lit("test"), "created_at": F.lit("2024-01-01")})
    made = conform(rows, "submission")
    assert [f.dataType for f in made.schema] == [f.dataType for f in store_schema("submission")]
    assert made.first()["status"] == "queued" and made.first()["completed_questions"] == 0
    with pytest.raises(ValueError):
        conform(rows.drop("kind"), "submission")
    assert [tuple(r) for r in key_violations({"submission": made}).collect()] == [("submission", "id", 1, 1, 1)]
    assert all(set(k) <= set(store_schema(n).fieldNames()) for n, keys in KEYS.items() for k in keys)
