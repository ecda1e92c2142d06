"""What a stream of events says about the state of the submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.operators.results import status_aggregates
from tarnwheel.operators.scoring import is_correct, with_scores
from tarnwheel.operators.windows import group_totals, running_sum
from tarnwheel.sources.records import format_record


def statuses(parsed: DataFrame) -> DataFrame:
    """Status per submission, with the error text of a failed one."""
    status, error = status_aggregates(F.col("event"), F.col("data.seq"), F.col("data.message"))
    known = parsed.where(F.col("data.submission_id").isNotNull())
    return known.groupBy(F.col("data.submission_id").alias("submission_id")).agg(
        status.alias("status"), error.alias("error_message")
    )


def final_rows(summary: DataFrame, state: DataFrame) -> DataFrame:
    """Accuracy and composite score of the submissions that are done."""
    done = state.where(F.col("status") == "done").select(F.col("submission_id").alias("done_id"))
    finished = summary.join(done, F.col("submission_id") == F.col("done_id"), "left_semi")
    return with_scores(finished)


def progress_records(answers: DataFrame) -> DataFrame:
    """One ``progress`` record per answered question with the correct ones so far."""
    counted = running_sum(
        answers, is_correct().cast("long"), ["submission_id"], ["index"], "correct_so_far"
    )
    held = group_totals(counted, ["submission_id"], total=F.count(F.lit(1)))
    payload = F.struct(
        F.lit("question_done").alias("step"), F.col("index"), F.col("total"), F.col("correct_so_far")
    )
    return held.select(
        "submission_id",
        "index",
        "total",
        "correct_so_far",
        format_record(F.lit("progress"), payload).alias("record"),
    )
