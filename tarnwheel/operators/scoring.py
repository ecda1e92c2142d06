"""Scores of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.functions import amount, clamp, power_floor, ratio, round_dp, units

# Fixed values of the scoring rules.
EPSILON = 1e-6
GPU_EXPONENT = 0.1
RAM_EXPONENT = 0.01
ACCURACY_WEIGHT = 70
PERFORMANCE_WEIGHT = 30
LATENCY_SHARE = 0.6
MEMORY_SHARE = 0.4
LATENCY_BEST_SECONDS = 2
LATENCY_RANGE_SECONDS = 58
MEMORY_BEST_MB = 4096
MEMORY_RANGE_MB = 36864
DEFAULT_GENERATION_SECONDS = 60.0
DEFAULT_EXECUTION_SECONDS = 10.0


def total(c: str) -> Column:
    """Exact sum of measurements with six places."""
    return amount(F.sum(units(c, 6)), 6)


def peak_usage(samples: DataFrame, *keys: str) -> DataFrame:
    """Greatest memory sample per key."""
    return samples.groupBy(*keys).agg(
        F.max("ram_mb").alias("peak_ram_mb"), F.max("gpu_mb").alias("peak_gpu_mb")
    )


def is_correct() -> Column:
    return F.coalesce(F.col("success") & F.col("exact_match"), F.lit(False))


def final_scores(answers: DataFrame, key: str) -> DataFrame:
    """Correct answers over generation time and damped mean memory, per run."""
    totals = answers.groupBy(key).agg(
        F.sum(is_correct().cast("long")).alias("correct"),
        total("generation_seconds").cast("double").alias("seconds"),
        ratio(total("peak_gpu_mb"), F.count(F.lit(1))).alias("gpu"),
        ratio(total("peak_ram_mb"), F.count(F.lit(1))).alias("ram"),
    )
    divisor = (
        F.greatest(F.coalesce("seconds", F.lit(0.0)), F.lit(EPSILON))
        * power_floor(F.coalesce("gpu", F.lit(0.0)), EPSILON, GPU_EXPONENT)
        * power_floor(F.coalesce("ram", F.lit(0.0)), EPSILON, RAM_EXPONENT)
    )
    score = F.when(F.col("correct") == 0, F.lit(0.0)).otherwise(round_dp(F.col("correct") / divisor, 6))
    return totals.select(key, "correct", score.alias("final_score"))


def composite_score(
    accuracy: Column, generation: Column, execution: Column, ram: Column, gpu: Column
) -> Column:
    """70 points for accuracy, 30 for latency and memory; nulls take the defaults."""
    latency = F.coalesce(generation, F.lit(DEFAULT_GENERATION_SECONDS)) + F.coalesce(
        execution, F.lit(DEFAULT_EXECUTION_SECONDS)
    )
    memory = F.greatest(F.coalesce(ram, F.lit(0.0)), F.coalesce(gpu, F.lit(0.0)))
    speed = clamp(1 - (latency - LATENCY_BEST_SECONDS) / LATENCY_RANGE_SECONDS, 0.0, 1.0)
    space = clamp(1 - (memory - MEMORY_BEST_MB) / MEMORY_RANGE_MB, 0.0, 1.0)
    performance = speed * LATENCY_SHARE + space * MEMORY_SHARE
    return F.coalesce(accuracy, F.lit(0.0)) * ACCURACY_WEIGHT + performance * PERFORMANCE_WEIGHT


def submission_aggregates() -> dict[str, Column]:
    """Aggregates of the answers of one submission, for batch and streaming."""
    return {
        "completed": F.count(F.lit(1)),
        "exact_matches": F.count(F.when(F.col("exact_match"), 1)),
        "avg_generation_seconds": ratio(total("generation_seconds"), F.count("generation_seconds")),
        "avg_execution_seconds": ratio(total("execution_seconds"), F.count("execution_seconds")),
        "peak_ram_mb": F.max("peak_ram_mb"),
        "peak_gpu_mb": F.max("peak_gpu_mb"),
    }


def summarise(answers: DataFrame, key: str) -> DataFrame:
    return answers.groupBy(key).agg(*[c.alias(n) for n, c in submission_aggregates().items()])


def with_scores(summary: DataFrame, places: int = 6) -> DataFrame:
    """Add accuracy and the composite score to the aggregates of a submission."""
    accuracy = ratio("exact_matches", F.greatest(F.col("completed"), F.lit(1)))
    scored = composite_score(
        F.col("accuracy"),
        F.col("avg_generation_seconds"),
        F.col("avg_execution_seconds"),
        F.col("peak_ram_mb"),
        F.col("peak_gpu_mb"),
    )
    return summary.withColumn("accuracy", accuracy).withColumn("composite_score", round_dp(scored, places))
