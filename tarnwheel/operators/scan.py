"""Prefix scans: windows whose keys are cut into ranges of their order, whatever their size.

A window puts all rows of one key into one task.  Here the rows, in the order of
(key, order, row hash), are cut into as many ranges as there are shuffle
partitions, and go to tasks by key and range.  A running value is the value inside
the range plus the sum of what the earlier ranges of the key hold: a prefix
scan over one partial per range.

The plan is the same for every input.  The limits of the ranges are quantiles of
a hash sample that the query takes itself; they decide only where the rows are
cut, so no result depends on them.  Rows that are equal in the order
are cut by the hash of their columns; only rows that are equal in all columns stay together.

Sizes are bounded by construction: n ranges have n - 1 limits, so fewer than n
keys are cut, into fewer than 2n parts; these alone are broadcast and have partials.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most, whatever the number of shuffle partitions.
MAX_RANGES = 10_000
#: Sampled rows per range.
SAMPLES = 16
#: Limits that the first step of a search skips at once.
BLOCK = 64

RANGE = "__range"
TIE = "__tie"
WHOLE = "__whole"


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality, because null is a window partition like any other."""
    condition = F.lit(True)
    for a, b in zip(left, right, strict=True):
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return condition


def cut_keys(rows: DataFrame, keys: list[str], order: list[str], ranges: int) -> DataFrame:
    """``__c_<key>..., __limits``: the keys that a quantile of (key, order) falls into, with its places in the order.

    The sample is the rows whose hash is 0 modulo the number of rows per
    sample; the count that this takes is a scalar subquery.  Equal rows are one,
    map-side, so a row that fills the table is sampled once.
    """
    count = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    stride = F.greatest(F.call_function("div", count, F.lit(ranges * SAMPLES)), F.lit(1))
    within = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(order)])
    place = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], within.alias("at"))
    sample = rows.where(F.pmod(F.xxhash64(*keys, *order), stride) == 0).select(place.alias("place"))
    sorted_ = sample.agg(F.array_sort(F.collect_set("place")).alias("all"))

    def part(i: Column) -> Column:
        return F.call_function("div", i * F.lit(ranges), F.size("all"))

    limits = F.filter("all", lambda _, i: (i > 0) & (part(i) != part(i - 1)))
    named = [F.col(f"limit.k{i}").alias(f"__c_{k}") for i, k in enumerate(keys)]
    return (
        sorted_.select(F.explode(limits).alias("limit"))
        .groupBy(*named)
        .agg(F.array_sort(F.collect_list("limit.at")).alias("__limits"))
        .withColumn("__heads", F.filter("__limits", lambda _, i: i % BLOCK == 0))
    )


@dataclass(frozen=True)
class Ranged:
    """Rows with their range (null if no limit cuts their key), and the columns of one window partition."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    descending: bool

    @property
    def partition(self) -> list[str]:
        return [*self.keys, RANGE]

    def by(self) -> list[Column]:
        """The order inside a range; rows that are equal in it have the order of their hashes."""
        columns = [F.col(c) for c in (*self.order, TIE)]
        return [c.desc() for c in columns] if self.descending else columns

    def of_cut_keys(self) -> DataFrame:
        return self.rows.where(F.col(RANGE).isNotNull())

    def earlier(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(RANGE)

    def with_partials(self, partials: DataFrame, name: str, default: object) -> DataFrame:
        """Join ``name`` of a row per cut key and range, fewer than two for each limit, to the rows."""
        named = partials.select(*[F.col(c).alias(f"__o_{c}") for c in self.partition], name)
        on = same_keys(self.partition, [f"__o_{c}" for c in self.partition])
        joined = self.rows.join(F.broadcast(named), on, "left").drop(*[f"__o_{c}" for c in self.partition])
        return joined.withColumn(name, F.coalesce(F.col(name), F.lit(default)))

    def with_offset(self, per_range: Column, name: str) -> DataFrame:
        """Add ``name``: the sum of ``per_range`` over the earlier ranges of the key."""
        parts = self.of_cut_keys().groupBy(*self.partition).agg(per_range.alias("__part"))
        before = self.earlier().rowsBetween(Window.unboundedPreceding, -1)
        return self.with_partials(parts.withColumn(name, F.sum("__part").over(before)), name, 0)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, descending: bool = False) -> Ranged:
    """Cut the rows into ranges of ``keys`` and ``order``, nulls first; ``descending`` numbers them backwards."""
    rows = df.withColumn(TIE, F.xxhash64(*df.columns))
    keys, order = list(keys), list(order)
    if not keys:
        # The same for all rows, but no literal, with which a join would have no key.
        rows, keys = rows.withColumn(WHOLE, F.pmod(TIE, F.lit(1))), [WHOLE]
    ranges = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    cut = cut_keys(rows, keys, [*order, TIE], ranges)
    held = rows.join(F.broadcast(cut), same_keys(keys, [f"__c_{k}" for k in keys]), "left")
    # Two steps of BLOCK comparisons find the range of a row among thousands.
    at = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate((*order, TIE))])
    heads = F.size(F.filter("__heads", lambda b: b <= at))
    first = F.greatest(heads - 1, F.lit(0)) * BLOCK
    found = first + F.size(F.filter(F.slice("__limits", first + 1, F.lit(BLOCK)), lambda b: b <= at))
    held = held.withColumn(RANGE, F.when(F.col("__limits").isNotNull(), -found if descending else found))
    return Ranged(held.drop("__limits", "__heads", *[f"__c_{k}" for k in keys]), keys, order, descending)
