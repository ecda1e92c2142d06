"""Streams that ingest event records.

The first answer to a question counts, however late a repeat arrives, so the keys
of all answers stay in the state: one small row per answer, not per record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.operators.results import last_wins
from tarnwheel.operators.scoring import submission_aggregates
from tarnwheel.sources.records import parse_records, stream_records

SPLITS = 64


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a stream, whose number of state partitions is fixed.

    The number cannot change after the first batch, so it is one per core instead
    of whatever the session uses for batch shuffles.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return own


def answers_of(parsed: DataFrame, *extra: str) -> DataFrame:
    """Flat answer rows of ``question_result`` records."""
    generated, executed = "data.generated_answer", "data.executed_answer"
    return parsed.where(F.col("event") == "question_result").select(
        *extra,
        "data.submission_id",
        "data.question_id",
        "data.seq",
        F.col(f"{executed}.success").alias("success"),
        F.col(f"{executed}.exact_match").alias("exact_match"),
        F.col(f"{generated}.generation_duration_seconds").alias("generation_seconds"),
        F.col(f"{executed}.execution_duration_seconds").alias("execution_seconds"),
        F.col(f"{generated}.peak_ram_mb").alias("peak_ram_mb"),
        F.col(f"{generated}.peak_gpu_mb").alias("peak_gpu_mb"),
    )


def aggregate_stream(
    spark: SparkSession, records: str, out: str, checkpoint: str, files_per_batch: int | None = None
):
    """Start the running aggregates per submission over deduplicated answers.

    Duplicates are dropped in two steps, first among the records of neighbouring
    file splits, so that many copies of one record do not meet in one task.  The
    split number depends on the place in the file only: a repeated task sends the
    same rows to the same place.

    Every batch writes the submissions it changed to a folder of its own, so a
    repeated batch overwrites itself.  ``latest_rows`` reads the result.
    """
    place = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    source = stream_records(spark, records, files_per_batch).select(
        "value", F.pmod(place, F.lit(SPLITS)).alias("split")
    )
    key = ["submission_id", "question_id"]
    answers = (
        answers_of(parse_records(source), "split")
        .dropDuplicates([*key, "split"])
        .dropDuplicates(key)
    )
    totals = answers.groupBy("submission_id").agg(
        *[c.alias(n) for n, c in submission_aggregates().items()]
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_rows(spark: SparkSession, out: str, key: str = "submission_id") -> DataFrame:
    """The last written row per key."""
    return last_wins(spark.read.parquet(out), [key], ["batch"]).drop("batch")


def route_stream(
    spark: SparkSession, records: str, out: str, checkpoint: str, files_per_batch: int | None = None
):
    """Start the stream that files every record under its event type."""
    parsed = parse_records(stream_records(spark, records, files_per_batch))
    return (
        parsed.select("event", "raw", "data")
        .writeStream.format("parquet")
        .partitionBy("event")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
