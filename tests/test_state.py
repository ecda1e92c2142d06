"""The streamed state of submissions against the batch forms over the same records."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tarnwheel.operators.results import first_wins, latest_attempt
from tarnwheel.operators.scoring import summarise
from tarnwheel.sources import records as sources
from tarnwheel.sources.records import parse_records, read_records, write_records
from tarnwheel.streaming import statuses, stream_session
from tarnwheel.streaming.jobs import answers_of
from tarnwheel.streaming.state import RECORD, absorb, bucket_of, state_statuses, state_stream, state_summary, state_tables


def record(kind, submission, seq, attempt=None, question=None, **more):
    data = {"submission_id": submission, "seq": seq, **more}
    if attempt is not None:
        data["attempt"] = attempt
    if question is not None:
        data |= {
            "question_id": question,
            "generated_answer": {"generation_duration_seconds": seq / 4, "peak_ram_mb": float(seq)},
            "executed_answer": {"success": True, "exact_match": seq % 2 == 0},
        }
    return f"event: {kind}\ndata: {json.dumps(data)}"


def some_records(seed: int) -> list[str]:
    """Retries, repeated answers with other contents, records after the end, broken records; one hot submission."""
    rng = random.Random(seed)
    out = []
    for seq in range(400):
        submission = 1 if rng.random() < 0.34 else rng.choice([None, *range(2, 12)])
        kind = rng.choice(["question_result"] * 6 + ["status", "done", "error"])
        question = f"Q{rng.randrange(5)}" if kind == "question_result" else None
        attempt = rng.choice([None, 0, 1, 1, 2]) if submission and submission % 3 == 0 else None
        out.append(record(kind, submission, seq, attempt, question, message=f"m{seq}"))
    rng.shuffle(out)
    return out + ["event: done\ndata: not json", "data: {}", "event: error"]


def by_batch(spark, records):
    """What the batch forms say about the latest attempts."""
    parsed = parse_records(spark.createDataFrame([(r,) for r in records], "value string"), RECORD)
    parsed = parsed.withColumn("submission_id", F.col("data.submission_id")).where("submission_id IS NOT NULL")
    parsed = parsed.withColumn("attempt", F.coalesce("data.attempt", F.lit(0).cast("long")))
    parsed = latest_attempt(parsed, "submission_id")
    answers = first_wins(answers_of(parsed), ["submission_id", "question_id"], ["seq"])
    return rows(statuses(parsed)), rows(summarise(answers, "submission_id"))


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def streamed(spark, folder):
    answers, submissions = state_tables(spark, folder)
    return rows(state_statuses(submissions)), rows(state_summary(answers, submissions))


def test_stream_is_the_batch(spark, tmp_path):
    records = some_records(3)
    for i in range(2):
        part = spark.createDataFrame([(r,) for r in records[i::2]], "value string").coalesce(1)
        write_records(part, f"{tmp_path}/in-{i}")
    stream = state_stream(
        stream_session(spark), f"{tmp_path}/in-*", f"{tmp_path}/state", f"{tmp_path}/offsets", 1
    )
    stream.awaitTermination()
    got = streamed(spark, f"{tmp_path}/state")
    assert got == by_batch(spark, records)
    answers, submissions = state_tables(spark, f"{tmp_path}/state")
    assert submissions.count() == submissions.select("submission_id").distinct().count() == 11


def batches(spark, folder, parts, keep):
    for number, part in enumerate(parts):
        absorb(spark.createDataFrame([(r,) for r in part], "value string"), number, folder, keep)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    records, folder = some_records(4), str(tmp_path / "state")
    batches(spark, folder, [records[:200], records[200:]], 1000)
    before = streamed(spark, folder)
    absorb(spark.createDataFrame([(r,) for r in records[200:]], "value string"), 1, folder, 1000)
    assert streamed(spark, folder) == before == by_batch(spark, records)


def test_batches_keep_little_on_disk(spark, tmp_path, monkeypatch):
    """A batch leaves no shuffles and no checkpoints, and writes over what the one before needed several times."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names, made = [], files.getAllFiles().iterator()
        while made.hasNext():
            names.append(made.next().getName())
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    def bytes_of(name):
        return sum(f.stat().st_size for f in (tmp_path / "state" / "work" / name).glob("*.parquet"))

    folder, all_records = str(tmp_path / "state"), some_records(6)
    part = spark.createDataFrame([(r,) for r in all_records], "value string").coalesce(1)
    monkeypatch.setattr(sources, "PER_FILE", 50)
    write_records(part, f"{tmp_path}/in", packed=True)
    assert len(list((tmp_path / "in").glob("*.gz"))) == -(-len(all_records) // 50)
    assert sorted(r[0].strip("\n") for r in read_records(spark, f"{tmp_path}/in").collect()) == sorted(all_records)
    before = shuffles()
    batches(spark, folder, [all_records], 1000)
    whole = bytes_of("answers")
    absorb(part.limit(3), 1, folder, 1000)
    assert {f.name for f in (tmp_path / "state" / "work").iterdir()} == {"answers", "submissions", "latest", "firsts"}
    assert 0 < bytes_of("answers") < whole
    assert len(shuffles() - before) <= 4 * spark.sparkContext.defaultParallelism


def test_state_ends_after_done(spark, tmp_path):
    folder = str(tmp_path / "state")
    first = [record("question_result", 1, 4, question="Q1"), record("done", 1, 9)]
    batches(spark, folder, [first], 2)
    same_bucket = neighbour(spark, 1)
    tick = [record("status", same_bucket, 1)]
    for number in (1, 2):
        absorb(spark.createDataFrame([(r,) for r in tick], "value string"), number, folder, 2)
    answers, submissions = state_tables(spark, folder)
    held = {r["submission_id"]: r for r in submissions.collect()}
    assert answers.count() == 0 and held[1]["totals"]["completed"] == 1 and held[same_bucket]["totals"] is None
    # A late answer of the ended attempt is dropped, a later attempt opens the submission again.
    late = [record("question_result", 1, 1, question="Q2")]
    absorb(spark.createDataFrame([(r,) for r in late], "value string"), 3, folder, 2)
    assert state_summary(*state_tables(spark, folder)).first()["completed"] == 1
    again = [record("question_result", 1, 20, attempt=1, question=q) for q in ("Q1", "Q2")]
    absorb(spark.createDataFrame([(r,) for r in again], "value string"), 4, folder, 2)
    answers, submissions = state_tables(spark, folder)
    status = {r["submission_id"]: r["status"] for r in state_statuses(submissions).collect()}
    assert answers.count() == 2 and status[1] == "running"
    assert state_summary(answers, submissions).first()["completed"] == 2


def neighbour(spark, submission):
    """Another submission of the same bucket."""
    numbered = spark.range(2000).select("id", bucket_of("id")).collect()
    return next(i for i, b in numbered if i != submission and b == numbered[submission][1])
