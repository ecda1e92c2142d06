"""Totals over process trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.session import reliable

#: Sums in a ring grow with every round until it is found; a decimal holds them.
TOTAL = "decimal(38,0)"


def _doubled(spans: DataFrame) -> DataFrame:
    """Spans of twice the length: totals of the far end's descendants, and its ancestor as the new far end.

    The sums are combined map-side, so a parent of very many processes gets a row
    per task, and the look-up of the far ends is a join with unique keys on one side.
    """
    gained = (
        spans.where(F.col("up").isNotNull())
        .groupBy(F.col("up").alias("g_pid"))
        .agg(*[F.sum(c).alias(f"g_{c}") for c in ("n", "known", "kb")])
    )
    far = spans.select(F.col("pid").alias("f_pid"), F.col("up").alias("f_up"), F.col("low").alias("f_low"))
    joined = spans.join(far, F.col("up") == F.col("f_pid"), "left").join(gained, F.col("pid") == F.col("g_pid"), "left")
    summed = [
        (F.col(c) + F.coalesce(F.col(f"g_{c}"), F.lit(0).cast(TOTAL))).cast(TOTAL).alias(c) for c in ("n", "known", "kb")
    ]
    low = F.least("low", F.coalesce(F.col("f_low"), F.col("low"))).alias("low")
    return joined.select("pid", F.col("f_up").alias("up"), low, *summed)


def tree_totals(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """Memory of every root and all its descendants, in MiB.

    ``processes`` has one row ``pid, ppid, rss_kb`` per process and ``roots`` the
    column ``root``; other columns are not read.  Ancestors are doubled: after k rounds a process knows
    its ancestor 2 ** k levels up and the totals of its descendants that are nearer,
    so a chain of n processes takes about log2(n) rounds.  Each round is
    checkpointed, so a lost executor does not replay the rounds before it.

    Parents that have ended have no memory but keep their children.  Repeated rows
    of a process are one, with its smallest parent and its largest memory.
    Processes that are each other's ancestors are a ring: the ends that are left after
    as many levels as there are processes.  All of a ring have the total of the ring and
    of what hangs below it, each process once.  A null parent is none, a null memory is
    unknown (the total is null if all are); rows without ``pid`` and roots without processes go.
    """
    parent = F.when(F.col("ppid") != F.col("pid"), F.col("ppid"))
    alive = processes.where(F.col("pid").isNotNull()).groupBy("pid").agg(
        F.min(parent).alias("up"), F.lit(1).alias("n"), F.max("rss_kb").alias("kb")
    )
    ended = alive.where(F.col("up").isNotNull()).select(F.col("up").alias("pid")).distinct()
    ended = ended.join(alive.select("pid"), "pid", "left_anti")
    ended = ended.select("pid", F.lit(None).cast("long").alias("up"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("kb"))
    spans = reliable(
        alive.unionByName(ended).select(
            "pid",
            "up",
            F.col("pid").alias("low"),
            F.col("n").cast(TOTAL).alias("n"),
            F.col("kb").isNotNull().cast("int").cast(TOTAL).alias("known"),
            F.coalesce("kb", F.lit(0)).cast(TOTAL).alias("kb"),
        )
    )
    nodes, levels, first = spans.count(), 1, spans
    while levels <= nodes and not spans.where(F.col("up").isNotNull()).isEmpty():
        spans, levels = reliable(_doubled(spans)), 2 * levels
    totals = _with_rings(first, spans).where(F.col("n") > 0)
    ram = F.when(F.col("known") > 0, F.col("kb").cast("double") / F.lit(1024.0))
    return (
        roots.select("root").distinct().join(totals, F.col("root") == F.col("pid"))
        .select("root", F.col("n").cast("long").alias("processes"), ram.alias("ram_mb"))
    )


def _with_rings(first: DataFrame, spans: DataFrame) -> DataFrame:
    """The totals, those of rings taken from the processes whose ancestors end in them.

    Far ends that are still there lie in rings, all of which are far ends, and have
    seen the smallest process of theirs.
    """
    endless = spans.where(F.col("up").isNotNull())
    rings = endless.select(F.col("up").alias("r_pid")).distinct().join(
        spans.select(F.col("pid").alias("r_pid"), F.col("low").alias("ring")), "r_pid"
    )
    below = endless.select("pid", "up").join(rings, F.col("up") == F.col("r_pid")).select("pid", "ring")
    sums = below.join(first, "pid").groupBy("ring").agg(*[F.sum(c).cast(TOTAL).alias(f"r_{c}") for c in ("n", "known", "kb")])
    of_ring = rings.join(sums, "ring")
    chosen = [F.coalesce(F.col(f"r_{c}"), F.col(c)).alias(c) for c in ("n", "known", "kb")]
    return spans.join(of_ring, F.col("pid") == F.col("r_pid"), "left").select("pid", *chosen)
