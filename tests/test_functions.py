"""Scalar helpers, fingerprints, comparison and scores."""

from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from tarnwheel.functions import (
    amount,
    last_json_line,
    mean_dp,
    money,
    n_unique,
    ratio,
    revenue,
    round_dp,
    slug,
    sum_dp,
    whole_days,
)
from tarnwheel.operators.fingerprint import (
    compare_runs,
    fingerprint,
    fingerprint_all,
    outcome,
    parse_payloads,
    require_table,
    row_differences,
)
from tarnwheel.operators.scoring import composite_score, final_scores
from tarnwheel.operators.store import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "places", "want"), [(1.005, 2, 1.01), (0.125, 2, 0.13), (2.5, 0, 3.0), (-1.005, 2, -1.01), (None, 2, None)]
)
def test_round(spark, value, places, want):
    assert one(spark, round_dp(F.lit(value).cast("double"), places)) == want


def test_money_is_exact(spark):
    df = spark.createDataFrame([(0.1, 0.05, 3.0)] * 10, "p double, d double, q double")
    got = df.agg(
        sum_dp(money("p")).alias("s"),
        sum_dp(revenue("p", "d", "q"), 4).alias("r"),
        mean_dp(money("p"), 4).alias("m"),
        amount(F.sum(money("p"))).alias("a"),
    ).first()
    assert (got["s"], got["r"], got["m"], str(got["a"])) == (1.0, 2.85, 0.1, "1.0000")


def test_empty_aggregates(spark):
    df = spark.createDataFrame([], "p double")
    got = df.agg(sum_dp(money("p")).alias("s"), mean_dp(money("p"), 2).alias("m"), n_unique("p").alias("n")).first()
    assert (got["s"], got["m"], got["n"]) == (0.0, None, 0)


def test_null_counts_as_a_value(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (1, 2), (2, None)], "g long, v long")
    got = {r["g"]: r["n"] for r in df.groupBy("g").agg(n_unique("v").alias("n")).collect()}
    assert got == {1: 2, 2: 1}


def test_tie_after_division(spark):
    assert one(spark, round_dp(ratio(F.lit(1584344.23), F.lit(14)), 2)) == 113167.45


def test_division_by_zero_is_null(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("2024-01-02 01:00:00", "2024-01-01 23:00:00", 0),
        ("2024-01-01 23:00:00", "2024-01-03 22:00:00", -1),
        ("2024-01-03 22:59:59", "2024-01-01 23:00:00", 1),
    ],
)
def test_whole_days(spark, a, b, want):
    assert one(spark, whole_days(F.lit(a), F.lit(b))) == want


def test_text_helpers(spark):
    assert one(spark, slug(F.lit("  Team Ünï & Co!!  "))) == "team-n-co"
    assert one(spark, slug(F.lit("x" * 60))) == "x" * 48
    text = F.lit('noise\n{"hash": "h"}\n\n  \n')
    assert one(spark, last_json_line(text, "hash string")["hash"]) == "h"
    assert one(spark, last_json_line(F.lit("Traceback"), "hash string")["hash"]) is None
    assert one(spark, last_json_line(F.lit(""), "hash string")["hash"]) is None


# Fingerprints


def sample(spark, n=50):
    return spark.range(n).select(
        "id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 3 == 0, F.lit("a,b")).alias("s")
    )


def hash_of(df):
    return fingerprint(df).first()["hash"]


def test_fingerprint_ignores_row_order(spark):
    df = sample(spark)
    want = hash_of(df)
    assert hash_of(df.repartition(9, "x")) == want
    assert hash_of(df.orderBy(F.desc("id"))) == want


def test_fingerprint_sees_every_change(spark):
    df = sample(spark)
    variants = [
        df,
        df.withColumn("x", F.when(F.col("id") == 7, 99.0).otherwise(F.col("x"))),
        df.union(df.limit(1)),
        df.where("id <> 3"),
        df.withColumn("s", F.coalesce("s", F.lit(""))),
        df.select("x", "id", "s"),
        df.withColumnRenamed("x", "y"),
    ]
    assert len({hash_of(v) for v in variants}) == len(variants)


def test_fingerprint_of_empty_result(spark):
    got = fingerprint(sample(spark).where("id < 0")).first()
    assert (got["shape"]["rows"], got["shape"]["cols"], got["columns"]) == (0, 3, ["id", "x", "s"])


def test_only_tables_are_results():
    with pytest.raises(TypeError):
        require_table([1, 2])


def test_comparison_is_three_valued(spark):
    good = '{"columns": ["a"], "shape": {"rows": 1, "cols": 1}, "hash": "h1"}'
    other = good.replace("h1", "h2")
    schema = "question_id string, ok boolean, stdout string"
    candidate = [("same", True, good), ("differs", True, other), ("fails", False, ""), ("gold_fails", True, good), ("garbled", True, "oops")]
    gold = [("same", True, good), ("differs", True, good), ("fails", True, good), ("gold_fails", False, ""), ("garbled", True, good)]
    out = compare_runs(
        parse_payloads(spark.createDataFrame(candidate, schema)), parse_payloads(spark.createDataFrame(gold, schema))
    ).withColumn("label", outcome(F.col("success"), F.col("exact_match")))
    got = {r["question_id"]: (r["success"], r["exact_match"], r["label"]) for r in out.collect()}
    assert got == {
        "same": (True, True, "OK"),
        "differs": (True, False, "WRONG"),
        "fails": (False, False, "FAIL"),
        "gold_fails": (False, None, "FAIL"),
        "garbled": (False, False, "FAIL"),
    }


def test_compare_real_results(spark):
    df = sample(spark)
    changed = df.where("id <> 3")
    candidate = fingerprint_all({"q1": df.repartition(3), "q2": changed})
    gold = fingerprint_all({"q1": df, "q2": df})
    got = {r["question_id"]: r["exact_match"] for r in compare_runs(candidate, gold).collect()}
    assert got == {"q1": True, "q2": False}
    assert [r["side"] for r in row_differences(changed, df).collect()] == ["missing"]


# Scores


def test_composite_defaults(spark):
    null = F.lit(None).cast("double")
    assert one(spark, composite_score(null, null, null, null, null)) == pytest.approx(12.0)
    best = composite_score(F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(100.0), F.lit(0.0))
    assert one(spark, best) == pytest.approx(100.0)
    middle = composite_score(F.lit(0.5), F.lit(30.0), F.lit(1.0), F.lit(22528.0), F.lit(100.0))
    assert one(spark, middle) == pytest.approx(35 + 30 * (0.6 * 0.5 + 0.4 * 0.5))


def test_final_score(spark):
    schema = "s long, success boolean, exact_match boolean, generation_seconds double, peak_gpu_mb double, peak_ram_mb double"
    data = [(1, True, True, 10.0, 0.0, 100.0), (1, True, False, 20.0, 0.0, 300.0), (2, True, None, 1.0, 1.0, 1.0)]
    got = {r["s"]: r["final_score"] for r in final_scores(spark.createDataFrame(data, schema), "s").collect()}
    assert got == {1: round(1 / (30 * 1e-6**0.1 * 200**0.01), 6), 2: 0.0}


def test_progress(spark):
    assert one(spark, progress(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, progress(F.lit(3), F.lit(4))) == 75.0
