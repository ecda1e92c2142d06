"""Mixing sources to target weights by bounded knapsacks over document lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.session import reliable

from .textpass import map_texts

#: Of so many of the shortest lengths one document is given back before the exact fit.
RELEASED = 64
BUCKETS = 256


def with_sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str, *more: str) -> DataFrame:
    """Id, source, columns ``more`` and number of space-separated words (``size``) of every row; null has none."""
    return map_texts(
        docs,
        {"doc_id": id_col, "source": source_col, **{c: c for c in more}},
        text_col,
        lambda: lambda text: (len(text.split()) if text else 0,),
        T.StructType([T.StructField("size", T.LongType())]),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """``key, source_size, target`` of every source.

    The sources in code point order, null last, weigh ``weights``, repeating.
    A target is ``least(max_repeats * source_size, level * weight)``; the level
    at which the targets share all words is found by rounds, each one sum.
    """
    order = Window.orderBy(F.col("key") == "", "key")
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = reliable(
        sizes.groupBy("key")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", cycle[(F.row_number().over(order) - 1) % len(weights)])
    )
    cap = F.col("source_size") * max_repeats
    level = -1.0
    while True:
        full = cap < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("budget"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if not row["open"]:
            break
        reached = (row["budget"] - row["capped"]) / row["open"]
        if reached <= level:
            break
        level = reached
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(max(level, 0.0)))
    return sources.select("key", "source_size", target.alias("target"))


def fit_budget(sizes: list[int], counts: list[int], budget: int, times: int = 1) -> list[int]:
    """How many documents of each size (ascending, positive) to take so that their words come closest to ``budget``.

    A document may be taken ``times`` times.  Every size first gives its share
    of the budget, rounded down, and what is left goes on to the shorter ones.
    The rest and one document of each of the shortest sizes are then a bounded
    knapsack: bit i of ``reach`` tells whether i words can be made, and
    multiplicities are cut into powers of two.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    taken = [0] * len(sizes)
    used = passed = 0
    for j in range(len(sizes) - 1, -1, -1):
        passed += sizes[j] * counts[j]
        taken[j] = max(0, min(counts[j], (budget * passed // total - used) // sizes[j]))
        used += taken[j] * sizes[j]
    for j in [j for j, k in enumerate(taken) if k][:RELEASED]:
        taken[j] -= 1
        used -= sizes[j]
    rest = budget - used
    # A surplus above the rest would be worse than taking nothing.
    mask, reach, layers = (1 << (2 * rest + 1)) - 1, 1, []
    for j, size in enumerate(sizes):
        left, piece = min(counts[j] * times - taken[j], 2 * rest // size), 1
        while left > 0 and not reach >> rest & 1:
            piece = min(piece, left)
            layers.append((j, piece, reach))
            reach |= (reach << (piece * size)) & mask
            left -= piece
            piece *= 2
        if size > 2 * rest or reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> rest
    at = rest + (above & -above).bit_length() - 1 if above else below
    at = below if rest - below <= at - rest else at
    for j, piece, before in reversed(layers):
        if not before >> at & 1:
            taken[j] += piece
            at -= piece * sizes[j]
    return taken


PLAN = "key string, size long, source_size long, target double, passes long, chosen long"


def plan_source(max_repeats: int):
    """Whole passes over the documents of each size, and how many of them are taken once more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        source_size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = min(int(target // source_size), max_repeats) if source_size else 0
        budget = min(round(target - passes * source_size), source_size) if passes < max_repeats else 0
        filled = rows[rows["size"] > 0]
        sizes, counts = filled["size"].tolist(), filled["n"].tolist()
        taken = fit_budget(sizes, counts, budget, max_repeats - passes) if sizes else []
        taken = pd.Series([0] * (len(rows) - len(filled)) + taken, index=rows.index, dtype="int64")
        out = rows[["key", "size", "source_size", "target"]]
        return out.assign(passes=passes + taken // rows["n"], chosen=taken % rows["n"])

    return run


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 17,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row.

    ``sizes`` can be given instead of being counted: ``doc_id, source, size`` per
    row, and columns to carry along.

    The mix has as many words as the documents; sources share it by weight and
    no document is taken more than ``max_repeats`` times.  Whole passes come
    first; the remaining budget is a knapsack over the source's table of lengths,
    and the documents of a length are drawn in the order of a seeded hash.  A source's
    plan holds one row per length, whatever its number of documents; draws are
    by bucket, so a length that many documents share is not one task.

    Null and empty texts have size 0 and are never taken; null is a source of
    its own, the last one.  Equal rows are separate documents, which may be
    taken differently; which of them is then arbitrary.  A table without words
    has targets of 0, an empty table an empty result.  Other columns are not read.
    """
    if sizes is None:
        sizes = with_sizes(docs, id_col, source_col, text_col)
    columns = sizes.columns
    sizes = sizes.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    lengths = sizes.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    plan = lengths.join(targets(sizes, weights, max_repeats), "key").groupBy("key").applyInPandas(plan_source(max_repeats), PLAN)

    draw = F.xxhash64("doc_id", F.lit(seed))
    drawn = sizes.withColumn("draw", draw).withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)))
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        drawn.groupBy("key", "size", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(plan, ["key", "size"])
        .withColumn("wanted", F.col("chosen") - F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n", "chosen")
    )
    within = Window.partitionBy("key", "size", "bucket").orderBy("draw", "doc_id")
    copies = F.col("passes") + (F.row_number().over(within) <= F.col("wanted")).cast("long")
    return (
        drawn.join(quotas, ["key", "size", "bucket"])
        .withColumn("copies", copies)
        .select(*columns, "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )
