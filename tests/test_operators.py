"""Operators on small frames with nulls, ties, hot keys and empty input."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarnwheel.operators import (
    anti_join,
    arg_first,
    dense_rank_desc,
    group_totals,
    growth_pct,
    join_suffix,
    ordinal_rank,
    pivot_sorted,
    previous_value,
    rolling_mean,
    running_count,
    running_sum,
    share_of_rows,
    top_k,
    top_pairs,
)
from tarnwheel.operators.closure import tree_totals
from tarnwheel.operators.results import first_wins, last_wins, latest_attempt


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])


# Joins


def test_join_suffix_keeps_left_names_and_order(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "b", 6.0)], "k long, name string, price double")
    right = spark.createDataFrame([(1, "x", 9.0)], "k long, name string, price double")
    out = join_suffix(left, right, "k")
    assert out.columns == ["k", "name", "price", "name_right", "price_right"]
    assert rows(out) == [(1, "a", 5.0, "x", 9.0)]


def test_join_suffix_self_and_roles(spark):
    staff = spark.createDataFrame([(1, "ann", None), (2, "bob", 1), (3, "cy", 1)], "id long, name string, boss long")
    out = join_suffix(staff, staff, left_on="boss", right_on="id", suffix="_mgr")
    assert out.columns == ["id", "name", "boss", "name_mgr", "boss_mgr"]
    assert rows(out.select("name", "name_mgr")) == [("bob", "ann"), ("cy", "ann")]


def test_join_null_keys_never_match(spark):
    left = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long")
    right = spark.createDataFrame([(None, 3), (2, 4)], "k long, w long")
    assert rows(join_suffix(left, right, "k")) == [(2, 2, 4)]
    assert rows(anti_join(left, right, "k")) == [(None, 1)]
    assert rows(join_suffix(left, right, "k", how="left")) == [(None, 1, None), (2, 2, 4)]


def test_join_refuses_double_names(spark):
    left = spark.createDataFrame([(1, 2, 3)], "k long, v long, v_right long")
    with pytest.raises(ValueError, match="v_right"):
        join_suffix(left, left.select("k", "v"), "k")


# Aggregates


def test_arg_first_and_top_k(spark):
    df = spark.createDataFrame(
        [("a", "x", 3), ("a", "y", 5), ("a", "w", 5), ("b", "z", None)], "g string, n string, v long"
    )
    best = arg_first(["n", "v"], [-F.col("v"), F.col("n")], largest=False)
    got = {r["g"]: r["b"] and r["b"]["n"] for r in df.groupBy("g").agg(best.alias("b")).collect()}
    assert got["a"] == "w"
    assert rows(top_k(df, 2, "v", "n").select("n")) == [("w",), ("y",)]
    with pytest.raises(ValueError):
        top_k(df, 1, "v")


def test_share_and_pivot(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 3.0), ("b", "p", 5.0)], "g string, c string, v double")
    grouped = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    share = grouped.select("g", share_of_rows(grouped, "n", df, 1).alias("pct"))
    assert rows(share) == [("a", 66.7), ("b", 33.3)]
    wide = pivot_sorted(df, "g", "c", ["q", "p"], F.avg("v"), fill=0.0)
    assert wide.columns == ["g", "p", "q"]
    assert rows(wide) == [("a", 1.0, 3.0), ("b", 5.0, 0.0)]


# Windows: each one against plain Python, with few and with many ranges


def events(seed, n=400, hot=0.34):
    """Unique positions; one key holds a third of the rows and there are many ties."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 1 if rng.random() < hot else rng.choice([None, *range(2, 40)])
        value = rng.choice([None, *range(-3, 9)])
        out.append((key, rng.randrange(6), i, value))
    return out


SCHEMA = "k long, t long, id long, v long"


def grouped(data):
    groups = defaultdict(list)
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    return groups


@pytest.fixture(params=["1", "40"])
def mode(request, spark):
    """Numbers of ranges: none cut, and so many that a range has about ten rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hot", [0.34, 1.0])
def test_cumulative_windows(spark, mode, hot):
    data = events(1, hot=hot)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    order = ["t", "id"]
    want_sum, want_count, want_rank, want_prev, want_roll = {}, {}, {}, {}, {}
    for group in grouped(data).values():
        total = seen = 0
        for i, (_, _, ident, v) in enumerate(group):
            total += v or 0
            seen += v is not None
            want_sum[ident] = None if v is None else total
            want_count[ident] = seen
            want_rank[ident] = i + 1
            want_prev[ident] = group[i - 1][3] if i else None
            last = [r[3] for r in group[max(0, i - 2) : i + 1]]
            full = len(last) == 3 and None not in last
            want_roll[ident] = sum(last) / 3 if full else None
    got = {r["id"]: r["x"] for r in running_sum(df, F.col("v"), ["k"], order, "x").collect()}
    assert got == want_sum
    got = {r["id"]: r["x"] for r in running_count(df, "v", ["k"], order, "x").collect()}
    assert got == want_count
    got = {r["id"]: r["x"] for r in ordinal_rank(df, ["k"], order, "x").collect()}
    assert got == want_rank
    got = {r["id"]: r["x"] for r in previous_value(df, "v", ["k"], order, "x").collect()}
    assert got == want_prev
    got = {r["id"]: r["x"] for r in rolling_mean(df, F.col("v"), ["k"], order, 3, "x").collect()}
    assert got == want_roll


@pytest.mark.parametrize("keys", [["k"], []])
def test_dense_rank_and_totals(spark, mode, keys):
    data = events(2)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    groups = defaultdict(list)
    for row in data:
        groups[row[0] if keys else 0].append(row)
    want, total = {}, {}
    for group in groups.values():
        values = sorted({r[3] for r in group if r[3] is not None}, reverse=True)
        for r in group:
            want[r[2]] = None if r[3] is None else values.index(r[3]) + 1
            total[r[2]] = sum(x[3] or 0 for x in group)
    got = {r["id"]: r["x"] for r in dense_rank_desc(df, "v", keys, "x").collect()}
    assert got == want
    if keys:
        got = {r["id"]: r["x"] for r in group_totals(df, keys, x=F.sum(F.coalesce("v", F.lit(0)))).collect()}
        assert got == total


def test_global_descending_rank(spark, mode):
    data = [(i, i * 7 % 101) for i in range(101)]
    df = spark.createDataFrame(data, "id long, v long")
    got = {r["v"]: r["x"] for r in ordinal_rank(df, [], ["v"], "x", descending=True).collect()}
    assert got == {v: 101 - v for v in range(101)}


def test_windows_of_empty_input(spark, mode):
    df = spark.createDataFrame([], SCHEMA)
    assert running_sum(df, F.col("v"), ["k"], ["id"], "x").collect() == []
    assert dense_rank_desc(df, "v", [], "x").collect() == []


def test_growth_has_no_zero_division(spark):
    df = spark.createDataFrame([("1", 0.0), ("2", 5.0), ("3", 10.0)], "m string, v double")
    assert rows(growth_pct(df, "v", "m", "g")) == [("1", 0.0, None), ("2", 5.0, None), ("3", 10.0, 100.0)]


# Pairs against brute force, narrow and wide


def best_pairs(data, k):
    groups = defaultdict(set)
    for g, m in data:
        groups[g].add(m)
    count = Counter()
    for members in groups.values():
        count.update(itertools.combinations(sorted(members), 2))
    return sorted(((a, b, n) for (a, b), n in count.items()), key=lambda p: (-p[2], p[0], p[1]))[:k]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("widest", [2, 6, 1000])
def test_top_pairs(spark, seed, widest):
    rng = random.Random(seed)
    data = [(rng.randrange(12), rng.randrange(14)) for _ in range(90)]
    data += [(99, m) for m in range(14)] * (1 + seed)  # a group with every member, repeated
    df = spark.createDataFrame(data, "g long, m long")
    got = [tuple(r) for r in top_pairs(df, "g", "m", 5, ("a", "b", "n"), widest=widest).collect()]
    assert got == best_pairs(data, 5)


def test_top_pairs_of_wide_groups_only(spark):
    data = [(g, m) for g in range(3) for m in range(8)]
    df = spark.createDataFrame(data, "g long, m long")
    got = [tuple(r) for r in top_pairs(df, "g", "m", 4, ("a", "b", "n"), widest=3).collect()]
    assert got == best_pairs(data, 4)


# Duplicates, attempts, trees


def test_first_last_and_latest(spark):
    data = [(1, "q1", 1, 10), (1, "q1", 2, 20), (1, "q2", 1, 30), (2, "q1", 1, 40)]
    df = spark.createDataFrame(data, "s long, q string, attempt long, seq long")
    assert rows(first_wins(df, ["s", "q"], ["seq"])) == [(1, "q1", 1, 10), (1, "q2", 1, 30), (2, "q1", 1, 40)]
    assert rows(last_wins(df, ["s", "q"], ["seq"])) == [(1, "q1", 2, 20), (1, "q2", 1, 30), (2, "q1", 1, 40)]
    assert rows(latest_attempt(df, "s")) == [(1, "q1", 2, 20), (2, "q1", 1, 40)]


def test_tree_totals_with_cycle(spark):
    processes = spark.createDataFrame(
        [(1, 0, 1024), (2, 1, 1024), (3, 2, 2048), (4, 4, 512), (5, 6, 100), (6, 5, 100)],
        "pid long, ppid long, rss_kb long",
    )
    roots = spark.createDataFrame([(1,), (4,), (5,), (77,)], "root long")
    assert rows(tree_totals(processes, roots)) == [(1, 3, 4.0), (4, 1, 0.5), (5, 2, 200 / 1024)]
