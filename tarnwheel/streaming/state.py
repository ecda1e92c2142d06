"""The state of submissions, kept up to date by a stream of event records.

A submission has attempts; only the latest one counts.  Of repeated answers to
one question the one with the least ``seq`` counts, however late it comes, and of
``done`` and ``error`` records the last by ``seq``.  Each batch is aggregated first, so that a
submission with many records enters the state as one row per task, and is then
merged with the buckets of the state that it touches.

A folder holds ``answers`` and ``submissions`` by batch and bucket, and a
``manifest`` per batch with the batch that holds each bucket's present rows.  A batch
reads what the manifest before it names and writes to folders of its own, so a
repeated batch overwrites itself and a half-written one is never read.  What a batch
needs several times is in ``work``, where the next one writes over it.

State ends: a submission that is done and has had no record for ``keep_batches``
batches is closed when its bucket is next written.  Its answers become one row of
totals, and later records of that attempt are dropped; a later attempt opens it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.operators.results import status_of
from tarnwheel.operators.scoring import summarise
from tarnwheel.session import (
    INITIAL_PARTITIONS,
    RUNTIME_DEFAULTS,
    apply_defaults,
    shuffles_dropped,
    start_partitions,
    stored,
)
from tarnwheel.sources.records import ANSWER, parse_records, stream_records

from .jobs import answers_of

BUCKETS = 64
KEEP_BATCHES = 100
#: Shuffle partitions that a batch starts from, per input split.
PER_SPLIT = 8
#: The records, with the attempt that they belong to; without one it is 0.
RECORD = T.StructType([*ANSWER.fields, T.StructField("attempt", T.LongType())])
FIRST = ["seq", "success", "exact_match", "generation_seconds", "execution_seconds", "peak_ram_mb", "peak_gpu_mb"]
TOTALS = ["completed", "exact_matches", "avg_generation_seconds", "avg_execution_seconds", "peak_ram_mb", "peak_gpu_mb"]

ANSWERS = """submission_id long, attempt long, question_id string, first struct<seq: long, success: boolean,
    exact_match: boolean, generation_seconds: double, execution_seconds: double, peak_ram_mb: double,
    peak_gpu_mb: double>, bucket int"""
SUBMISSIONS = """submission_id long, attempt long, done long, failed struct<seq: long, message: string>,
    last_batch long, totals struct<completed: long, exact_matches: long, avg_generation_seconds: double,
    avg_execution_seconds: double, peak_ram_mb: double, peak_gpu_mb: double>, bucket int"""
MANIFEST = "bucket int, version long"


def bucket_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


def news(records: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``ANSWERS`` and of ``SUBMISSIONS`` that one batch of records amounts to."""
    parsed = parse_records(records, RECORD).where(F.col("data.submission_id").isNotNull())
    parsed = parsed.withColumn("attempt", F.coalesce("data.attempt", F.lit(0).cast("long")))
    answers = (
        answers_of(parsed, "attempt")
        .groupBy("submission_id", "attempt", "question_id")
        .agg(F.min(F.struct(*FIRST)).alias("first"))
        .withColumn("bucket", bucket_of("submission_id"))
    )
    kind, seq = F.col("event"), F.col("data.seq")
    submissions = (
        parsed.groupBy(F.col("data.submission_id").alias("submission_id"), "attempt")
        .agg(
            F.max(F.when(kind == "done", seq)).alias("done"),
            F.max(F.when(kind == "error", F.struct(seq.alias("seq"), F.col("data.message").alias("message")))).alias("failed"),
        )
        .withColumn("last_batch", F.lit(batch_id).cast("long"))
        .withColumn("totals", F.lit(None).cast(T.StructType.fromDDL(SUBMISSIONS)["totals"].dataType))
        .withColumn("bucket", bucket_of("submission_id"))
    )
    return answers, submissions


def versions(spark: SparkSession, folder: str, batch_id: int) -> dict[int, int]:
    """Batch that holds the present rows of each bucket after ``batch_id``; at most ``BUCKETS`` entries."""
    if batch_id < 0:
        return {}
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/batch={batch_id}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def present(spark: SparkSession, folder: str, table: str, schema: str, held: dict[int, int]) -> DataFrame:
    """The rows of the given buckets, read from the batches that hold them."""
    if not held:
        return spark.createDataFrame([], schema)
    wanted = F.lit(False)
    for version in sorted(set(held.values())):
        wanted = wanted | ((F.col("batch") == version) & F.col("bucket").isin([b for b, v in held.items() if v == version]))
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{table}").where(wanted)
    return rows.select(*T.StructType.fromDDL(schema).names)


def merge(
    answers: DataFrame,
    submissions: DataFrame,
    old_answers: DataFrame,
    old_submissions: DataFrame,
    batch_id: int,
    keep: int,
    work: str,
) -> tuple[DataFrame, DataFrame]:
    """The new rows of both tables for the buckets that a batch touches; ``work`` is a folder for what is used twice."""
    closed = old_submissions.where("totals IS NOT NULL").select(
        F.col("submission_id").alias("__id"), F.col("attempt").alias("__attempt")
    )
    ended = (F.col("submission_id") == F.col("__id")) & (F.col("attempt") <= F.col("__attempt"))
    attempts = (
        old_submissions.unionByName(submissions.join(closed, ended, "left_anti"))
        .groupBy("submission_id", "attempt", "bucket")
        .agg(
            F.max("done").alias("done"),
            F.max("failed").alias("failed"),
            F.max("last_batch").alias("last_batch"),
            F.max("totals").alias("totals"),
        )
    )
    row = F.struct("attempt", "done", "failed", "last_batch", "totals")
    latest = attempts.groupBy("submission_id", "bucket").agg(F.max(row).alias("row"))
    latest = stored(latest.select("submission_id", "row.*", "bucket"), "latest", f"{work}/latest")
    opened = latest.where("totals IS NULL").select("submission_id", "attempt", "last_batch", "done", "failed")
    quiet = F.col("last_batch") <= batch_id - keep
    opened = opened.withColumn("ends", (status_of(F.col("done"), F.col("failed.seq")) == "done") & quiet)
    firsts = (
        old_answers.unionByName(answers)
        .join(opened.select("submission_id", "attempt", "ends"), ["submission_id", "attempt"])
        .groupBy("submission_id", "attempt", "question_id", "bucket", "ends")
        .agg(F.min("first").alias("first"))
    )
    firsts = stored(firsts, "firsts", f"{work}/firsts")
    ended_now = opened.where("ends").select("submission_id")
    totals = summarise(firsts.where("ends").select("submission_id", "first.*"), "submission_id")
    none = {"completed": 0, "exact_matches": 0}
    totals = ended_now.join(totals, "submission_id", "left").fillna(none).select("submission_id", F.struct(*TOTALS).alias("new"))
    held = latest.join(totals, "submission_id", "left").withColumn("totals", F.coalesce("totals", "new"))
    names = T.StructType.fromDDL(SUBMISSIONS).names
    return firsts.where(~F.col("ends")).select(*T.StructType.fromDDL(ANSWERS).names), held.select(*names)


@contextmanager
def sized(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Shuffles whose tasks do not grow: the function given back lets them start from partitions in
    proportion to the input splits of some frames.  The settings before come back at the end."""
    names = [*RUNTIME_DEFAULTS, INITIAL_PARTITIONS]
    before = {name: spark.conf.get(name, None) for name in names}
    apply_defaults(spark)
    try:
        yield lambda *frames: start_partitions(spark, PER_SPLIT * sum(f.rdd.getNumPartitions() for f in frames))
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def absorb(records: DataFrame, batch_id: int, folder: str, keep: int) -> None:
    """Merge one batch of records into the state."""
    with sized(records.sparkSession) as fit:
        _absorb(records, batch_id, folder, keep, fit)


def _absorb(records: DataFrame, batch_id: int, folder: str, keep: int, fit: Callable[..., None]) -> None:
    spark = records.sparkSession
    fit(records)
    work = f"{folder}/work"
    answers, submissions = (
        stored(rows, name, f"{work}/{name}") for name, rows in zip(("answers", "submissions"), news(records, batch_id), strict=True)
    )
    before = versions(spark, folder, batch_id - 1)
    touched = [r["bucket"] for r in submissions.select("bucket").distinct().collect()]
    held = {b: before[b] for b in touched if b in before}
    old_answers = present(spark, folder, "answers", ANSWERS, held)
    old_submissions = present(spark, folder, "submissions", SUBMISSIONS, held)
    fit(records, old_answers, old_submissions)
    tables = merge(answers, submissions, old_answers, old_submissions, batch_id, keep, work)
    with shuffles_dropped(spark):
        for name, rows in zip(("answers", "submissions"), tables, strict=True):
            # A file per bucket, or more where a bucket is large.
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}/batch={batch_id}")
    now = before | dict.fromkeys(touched, batch_id)
    manifest = spark.createDataFrame(sorted(now.items()), MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch_id}")


def state_stream(
    spark: SparkSession,
    records: str,
    folder: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    keep_batches: int = KEEP_BATCHES,
):
    """Start the stream that keeps the state of all submissions in ``folder``.

    Records without a submission are ignored; answers without a question are
    answers to one question; the least ``seq`` is a missing one.
    """
    return (
        stream_records(spark, records, files_per_batch)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: absorb(batch, batch_id, folder, keep_batches))
        .start()
    )


def state_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``ANSWERS`` of the open submissions and ``SUBMISSIONS``, as the last complete batch has left them."""
    batches = spark.read.parquet(f"{folder}/manifest").agg(F.max("batch").alias("last")).first()
    held = versions(spark, folder, batches["last"])
    return present(spark, folder, "answers", ANSWERS, held), present(spark, folder, "submissions", SUBMISSIONS, held)


def state_statuses(submissions: DataFrame) -> DataFrame:
    """Status and error text per submission, as ``statuses`` has them for a batch."""
    status = status_of(F.col("done"), F.col("failed.seq"))
    message = F.substring(F.coalesce("failed.message", F.lit("Backend error")), 1, 2000)
    return submissions.select(
        "submission_id", status.alias("status"), F.when(status == "failed", message).alias("error_message")
    )


def state_summary(answers: DataFrame, submissions: DataFrame) -> DataFrame:
    """Aggregates of the answers per submission, open ones and closed ones."""
    open_ = summarise(answers.select("submission_id", "first.*"), "submission_id")
    closed = submissions.where("totals.completed > 0").select("submission_id", "totals.*")
    return open_.unionByName(closed)
