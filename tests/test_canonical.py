"""Canonical order and its digest, process trees by doubling, keys and counts in one pass."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from support import DATA
from tarnwheel.operators import closure
from tarnwheel.operators.canonical import COPIES, MODULI, canonical_positions, ordered_digest, power
from tarnwheel.operators.closure import tree_totals
from tarnwheel.operators.fingerprint import row_differences
from tarnwheel.sources.corpus import inline_table
from tarnwheel.sources.store import key_violations
from tarnwheel.sources.tables import footer_session, table_summary

SCHEMA = "a long, b string, a_b double"


def digest(df):
    return ordered_digest(df).collect()[0]


def sample(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", "x", 'q"', "ü\n"]), rng.choice([None, 0.5, 1e300])) for _ in range(n)]


def test_digest_depends_on_rows_only(spark):
    data = sample(400)
    df = spark.createDataFrame(data, SCHEMA)
    got = digest(df)
    assert (got["shape"]["rows"], got["shape"]["cols"]) == (400, 3)
    assert digest(spark.createDataFrame(sorted(data, key=repr), SCHEMA).repartition(7)) == got
    assert digest(spark.createDataFrame(data[1:], SCHEMA)) != got
    assert digest(spark.createDataFrame(data[1:] + data[1:2], SCHEMA))["hash"] != got["hash"]
    assert digest(df.toDF("a", "b", "c"))["hash"] != got["hash"]


def test_digest_of_a_sequence_of_tasks(spark):
    """More ranges than one: the merged digest is that of one task."""
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7 % 11).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = digest(df)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = digest(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert many == one


def test_digest_special_cases(spark):
    empty = digest(spark.createDataFrame([], SCHEMA))
    assert empty["shape"]["rows"] == 0 and len(empty["hash"]) == 16
    zeros = [spark.createDataFrame([(z,)], "x double") for z in (0.0, -0.0)]
    assert digest(zeros[0]) == digest(zeros[1])
    clashing = spark.createDataFrame([(1, 2), (3, 4)], "x long, y long").toDF("x", "x")
    assert digest(clashing)["shape"]["rows"] == 2
    with pytest.raises(TypeError):
        ordered_digest([1])


def test_digest_sorts_in_many_tasks(spark):
    plan = ordered_digest(spark.read.parquet(str(DATA / "sf0.001" / "nation.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(c0" in plan and "Sort [c0" in plan


@pytest.mark.parametrize("exponent", [0, 1, 63, 64, 12345, 2**33 - 1])
def test_power(spark, exponent):
    df = spark.range(1).select(F.lit(exponent).cast("long").alias("e"))
    for p, r in MODULI:
        assert df.select(F.expr(power(r, p, "e", 33))).collect()[0][0] == pow(r, exponent, p)


def test_positions(spark):
    data = sample(300, 2)
    nulls_first = sorted(data, key=lambda row: [(v is not None, (v or 0) if i != 1 else (v or "")) for i, v in enumerate(row)])
    got = canonical_positions(spark.createDataFrame(data, SCHEMA)).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(300))
    assert [tuple(r)[:3] for r in got] == nulls_first
    assert canonical_positions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_positions_of_very_many_copies(spark):
    n = 3 * COPIES + 5
    df = spark.range(n).select(F.lit(1).alias("x")).union(spark.createDataFrame([(0,), (2,)], "x int"))
    got = canonical_positions(df).groupBy("x").agg(F.min("position"), F.max("position"), F.countDistinct("position"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 0, 1), (1, 1, n, n), (2, n + 1, n + 1, 1)]


def brute_totals(parents, memory, roots):
    children = {}
    for child, parent in parents.items():
        children.setdefault(parent, set()).add(child)
    out = {}
    for root in roots:
        seen, todo = set(), [root]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += children.get(at, ())
        alive = [p for p in seen if p in memory]
        known = [memory[p] for p in alive if memory[p] is not None]
        if alive:
            out[root] = (len(alive), sum(known) / 1024 if known else None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_trees_and_rings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pids = rng.sample(range(100), 45)
    parents = {p: rng.choice([None, *range(100)] if seed % 2 else [0, *pids]) for p in pids}
    memory = {p: rng.choice([None, 1, 1024, 3000]) for p in pids}
    df = spark.createDataFrame([(p, parents[p], memory[p], "x") for p in pids], "pid long, ppid long, rss_kb long, up string")
    roots = spark.createDataFrame([(r,) for r in range(100)] + [(pids[0],), (None,)], "root long")
    got = {r["root"]: (r["processes"], r["ram_mb"]) for r in tree_totals(df, roots).collect()}
    assert got == brute_totals(parents, memory, range(100))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    doubled = closure._doubled
    monkeypatch.setattr(closure, "_doubled", lambda spans: rounds.append(1) or doubled(spans))
    chain = spark.range(100_000).select(F.col("id").alias("pid"), (F.col("id") - 1).alias("ppid"), F.lit(1024).alias("rss_kb"))
    roots = spark.createDataFrame([(0,), (60_000,)], "root long")
    assert sorted(map(tuple, tree_totals(chain, roots).collect())) == [(0, 100_000, 100_000.0), (60_000, 40_000, 40_000.0)]
    assert len(rounds) < 20


def test_trees_of_nothing(spark):
    none = spark.createDataFrame([], "pid long, ppid long, rss_kb long")
    assert tree_totals(none, spark.createDataFrame([(1,)], "root long")).count() == 0


def test_keys_in_one_pass(spark):
    schema = "team_id string, user_id string, role string, joined_at timestamp_ntz"
    rows = [("t", "u", "m", None), ("t", "u", "m", None), ("s", "u", None, None), (None, None, "m", None)]
    members = spark.createDataFrame(rows, schema)
    got = key_violations({"team_member": members})
    assert [tuple(r) for r in got.collect()] == [("team_member", "team_id,user_id", 1, 1, 4), ("team_member", "user_id", 1, 2, 4)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    empty = key_violations({"team_member": members.limit(0)}).collect()
    assert [tuple(r)[2:] for r in empty] == [(0, 0, 0), (0, 0, 0)]


def test_counts_come_from_footers(spark):
    own = footer_session(spark)
    tables = {n: own.read.parquet(str(DATA / "sf0.001" / f"{n}.parquet")) for n in ("orders", "part")}
    plan = table_summary(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == plan.count("BatchScan") == 2
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_inline_tables(spark):
    schema = T.StructType().add("a", "long").add("b", "string")
    assert inline_table(spark, {"a": [1, 2], "b": ["x", None]}, schema).collect() == [(1, "x"), (2, None)]
    assert inline_table(spark, [{"b": "x"}, {"a": 2}], schema).collect() == [(None, "x"), (2, None)]
    assert inline_table(spark, [], schema).count() == 0
    for wrong in ({"a": [1], "b": []}, {"a": [1], "b": ["x"], "c": [1]}, [{"c": 1}]):
        with pytest.raises(ValueError):
            inline_table(spark, wrong, schema)


@pytest.mark.parametrize("leaves", [1, 7, 65_536])
def test_row_differences_against_counts(spark, leaves):
    ours, theirs = sample(300, 3), sample(300, 4)
    gold, other = spark.createDataFrame(ours, SCHEMA), spark.createDataFrame(theirs, SCHEMA).select("a_b", "b", "a")
    got = Counter(map(tuple, row_differences(other, gold, leaves).collect()))
    missing, extra = Counter(ours) - Counter(theirs), Counter(theirs) - Counter(ours)
    assert got == Counter({(*r, "missing"): n for r, n in missing.items()} | {(*r, "extra"): n for r, n in extra.items()})
    assert row_differences(gold.repartition(5), gold, leaves).count() == 0
    assert row_differences(gold.limit(0), gold, leaves).count() == 300


def test_equal_tables_are_shuffled_as_sums_only(spark):
    def shuffled(changed):
        """Records that each shuffle of the whole comparison writes."""
        df = spark.read.parquet(str(DATA / "sf0.001" / "lineitem.parquet"))
        other = df.withColumn("l_tax", F.when(F.col("l_orderkey") == changed, 9.0).otherwise(F.col("l_tax")))
        found = row_differences(other, df, 16)
        found.collect()
        plan, written = found._jdf.queryExecution().executedPlan(), []
        todo = [plan.finalPhysicalPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
                node = node.plan()
            if node.nodeName() == "Exchange":
                written.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return written

    assert sum(shuffled(-1)) <= 2 * 16 * 8
    assert sum(shuffled(201)) > 2 * 16 * 8
