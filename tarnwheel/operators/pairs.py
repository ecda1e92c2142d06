"""Most frequent pairs of members that share a group.

A self-join of a group with m members gives m² / 2 pairs, so it is used only for
groups of limited width.  Wide groups are never paired up row by row:

* pairs that also meet in a narrow group are known from there, and the wide
  groups they share are counted for those pairs only;
* all other pairs meet in wide groups alone.  Members of the same set of wide
  groups are interchangeable for them, so one pair of such classes stands for
  all its member pairs, and the k smallest of these suffice for the top k.

Both parts are exact, and the second one is skipped for every class with too few
wide groups to reach the k-th best pair already found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.session import reliable

from .topk import top_k

WIDEST = 256


def _narrow_pairs(members: DataFrame) -> DataFrame:
    left = members.select("grp", F.col("mem").alias("a"))
    right = members.select(F.col("grp").alias("grp_b"), F.col("mem").alias("b"))
    met = left.join(right, (F.col("grp") == F.col("grp_b")) & (F.col("a") < F.col("b")))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _shared_wide(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Add the wide groups that both members of a known pair belong to."""
    of_a = wide.select(F.col("mem").alias("ma"), F.col("grp").alias("ga"))
    of_b = wide.select(F.col("mem").alias("mb"), F.col("grp").alias("gb"))
    extra = (
        pairs.join(of_a, F.col("a") == F.col("ma"))
        .join(of_b, (F.col("b") == F.col("mb")) & (F.col("ga") == F.col("gb")))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("extra"))
        .select(F.col("a").alias("xa"), F.col("b").alias("xb"), "extra")
    )
    return pairs.join(extra, (F.col("a") == F.col("xa")) & (F.col("b") == F.col("xb")), "left").select(
        "a", "b", (F.col("n") + F.coalesce("extra", F.lit(0))).alias("n")
    )


def _class_pairs(wide: DataFrame, k: int, floor: int) -> DataFrame:
    """Best pairs by wide groups alone, from classes with at least ``floor`` of them."""
    mark = F.xxhash64("grp", F.lit("a"))
    other = F.xxhash64("grp", F.lit("b"))
    classes = (
        wide.groupBy("mem")
        .agg(F.count(F.lit(1)).alias("size"), F.bit_xor(mark).alias("h1"), F.bit_xor(other).alias("h2"))
        .where(F.col("size") >= floor)
        .withColumn("cls", F.struct("size", "h1", "h2"))
        .select("mem", "cls")
    )
    smallest = Window.partitionBy("cls").orderBy("mem")
    picked = (
        classes.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    )
    first = picked.where("nth = 1").select("cls", F.col("mem").alias("first"))
    groups = first.join(wide, F.col("first") == F.col("mem")).select("cls", "grp")
    left = groups.select(F.col("cls").alias("cls_a"), "grp")
    right = groups.select(F.col("cls").alias("cls_b"), F.col("grp").alias("grp_b"))
    shared = (
        left.join(right, (F.col("grp") == F.col("grp_b")) & (F.col("cls_a") <= F.col("cls_b")))
        .groupBy("cls_a", "cls_b")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= floor)
    )
    of_a = picked.select(F.col("cls").alias("ca"), F.col("mem").alias("ma"))
    of_b = picked.select(F.col("cls").alias("cb"), F.col("mem").alias("mb"))
    return (
        shared.join(of_a, F.col("cls_a") == F.col("ca"))
        .join(of_b, F.col("cls_b") == F.col("cb"))
        .where(F.col("ma") != F.col("mb"))
        .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"), "n")
    )


def top_pairs(
    df: DataFrame, group: str, member: str, k: int, names: tuple[str, str, str], *, widest: int = WIDEST
) -> DataFrame:
    """The k pairs with the most common groups; ties go to the smallest members."""
    rows = df.select(F.col(group).alias("grp"), F.col(member).alias("mem")).na.drop()
    members = rows.distinct()
    out = [F.col(c).alias(n) for c, n in zip(("a", "b", "n"), names, strict=True)]
    # More rows than members is possible, fewer is not: no wide count, no wide group.
    if rows.groupBy("grp").count().where(F.col("count") > widest).isEmpty():
        return top_k(_narrow_pairs(members), k, "n", "a", "b").select(*out)

    sizes = members.groupBy(F.col("grp").alias("wide_grp")).count().where(F.col("count") > widest)
    is_wide = F.col("grp") == F.col("wide_grp")
    wide = reliable(members.join(sizes, is_wide, "left_semi"))
    narrow = reliable(_narrow_pairs(members.join(sizes, is_wide, "left_anti")))
    best = top_k(narrow, k, "n", "a", "b").agg(F.min("n"), F.count(F.lit(1))).first()
    floor = best[0] if best[1] == k else 1
    reach = wide.groupBy(F.col("mem").alias("who")).agg(F.count(F.lit(1)).alias("reach"))
    bounded = (
        narrow.join(reach.toDF("who_a", "reach_a"), F.col("a") == F.col("who_a"), "left")
        .join(reach.toDF("who_b", "reach_b"), F.col("b") == F.col("who_b"), "left")
        .where(
            F.col("n") + F.coalesce(F.least(F.coalesce("reach_a", F.lit(0)), F.coalesce("reach_b", F.lit(0))), F.lit(0))
            >= floor
        )
        .select("a", "b", "n")
    )
    known = _shared_wide(bounded, wide)
    found = known.unionByName(_class_pairs(wide, k, floor))
    # A pair of both parts is complete in the first one, which is never smaller.
    best_of = found.groupBy("a", "b").agg(F.max("n").alias("n"))
    return top_k(best_of, k, "n", "a", "b").select(*out)
