"""Sharding by balanced label propagation: linked documents together, counts equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.session import reliable

from .numbering import numbered

#: Priorities of moves; the driver gets one sum per shard and priority.
PRIORITIES = 512


def accept(moves: DataFrame, room: dict[int, int]) -> DataFrame:
    """Add ``accepted``: how many of the ``n`` documents of each move to ``to`` fit into its room.

    Moves go by a hash of the group and the shard they leave.  The driver gets sums per shard and
    priority; the priority at which a shard gets full is shared out in
    proportion, rounded down, so the room is never exceeded.
    """
    ranked = moves.withColumn("priority", F.pmod(F.xxhash64("grp", "shard"), F.lit(PRIORITIES)).cast("int"))
    sums = ranked.groupBy("to", "priority").agg(F.sum("n").alias("n")).collect()
    # Per shard: the first priority that does not fit as a whole, the room it still has, and its sum.
    edge: dict[int, tuple[int, int, int]] = {}
    for to, space in room.items():
        left = max(space, 0)
        for row in sorted((r for r in sums if r["to"] == to), key=lambda r: r["priority"]):
            if row["n"] > left:
                edge[to] = (row["priority"], left, row["n"])
                break
            left -= row["n"]

    def pick(i: int, default: int) -> Column:
        pairs = [F.lit(x) for to, e in sorted(edge.items()) for x in (to, e[i])]
        return F.coalesce(F.create_map(*pairs)[F.col("to")], F.lit(default)) if pairs else F.lit(default)

    at = pick(0, PRIORITIES)
    part = F.floor(F.col("n") * (pick(1, 0) / pick(2, 1))).cast("long")
    fits = F.when(F.col("priority") < at, F.col("n")).when(F.col("priority") == at, part).otherwise(F.lit(0))
    return ranked.withColumn("accepted", fits.cast("long")).drop("priority")


def loads(state: DataFrame, shards: int) -> dict[int, int]:
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return {s: held.get(s, 0) for s in range(shards)}


def propagate(state: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """Move the documents of every group towards the shard that holds most of them.

    ``state`` has a row ``grp, shard, n`` per group and shard: members of a
    group in one shard are alike, so labels are counts and a group of any size
    has at most one row per shard.  In each round a group looks at its counts
    (its neighbours' labels) in the shards that still have room, and what lies
    in shards with fewer of its documents moves there as far as quotas allow.
    Shards above the quota at the end give up what is too much (shard -1).
    """
    state = reliable(state)
    for _ in range(rounds):
        held = loads(state, shards)
        room = {s: quota - n for s, n in held.items()}
        open_shards = [s for s, n in room.items() if n > 0]
        if not open_shards:
            break
        choice = F.max(F.when(F.col("shard").isin(open_shards), F.struct("n", (-F.col("shard")).alias("s"))))
        wanted = state.groupBy("grp").agg(choice.alias("best")).where("best IS NOT NULL")
        moves = (
            state.join(wanted, "grp")
            .withColumn("to", -F.col("best.s"))
            .where((F.col("shard") != F.col("to")) & ((F.col("n") <= F.col("best.n")) | (F.col("shard") < 0)))
            .select("grp", "shard", "to", "n")
        )
        moved = reliable(accept(moves, room).where("accepted > 0"))
        if moved.isEmpty():
            break
        state = reliable(
            state.unionByName(moved.select("grp", "shard", (-F.col("accepted")).alias("n")))
            .unionByName(moved.select("grp", F.col("to").alias("shard"), F.col("accepted").alias("n")))
            .groupBy("grp", "shard")
            .agg(F.sum("n").alias("n"))
            .where("n > 0")
        )
    kept = accept(state.withColumn("to", F.col("shard")), {s: quota for s in range(shards)})
    split = F.array(
        F.struct(F.col("shard").alias("shard"), F.col("accepted").alias("n")),
        F.struct(F.lit(-1).alias("shard"), (F.col("n") - F.col("accepted")).alias("n")),
    )
    return (
        kept.select("grp", F.inline(split))
        .where("n > 0")
        .groupBy("grp", "shard")
        .agg(F.sum("n").alias("n"))
    )


def starts_of(counts: list[int]) -> list[int]:
    out = [0]
    for n in counts:
        out.append(out[-1] + n)
    return out


def shard_of(position: Column, counts: list[int]) -> Column:
    """The shard of a position in consecutive ranges of the given sizes."""
    out = F.lit(None).cast("int")
    for shard, start in reversed(list(enumerate(starts_of(counts)[:-1]))):
        out = F.when(position >= start + counts[shard], out).otherwise(F.lit(shard))
    return out


def shard_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    rounds: int = 20,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, by the law ``rows``.

    Counts per shard differ by one at most, and slots number the rows of a
    shard from 0.  Documents with equal texts are linked; balanced label
    propagation brings the groups together under a quota of ``rows / shards``
    per shard, so only a group larger than that is split, over few shards.
    Unlinked documents then fill every shard exactly.  The driver gets counts
    per shard, never documents or groups.

    A null text has size 1 and the checksum of an empty text, and is linked to
    nothing; empty texts are equal texts.  Rows with equal ids are placed one by
    one, in an arbitrary order among themselves.  An empty table gives an empty
    result; fewer rows than shards leave shards empty.
    """
    text = F.col(text_col).cast("string")
    rows = reliable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("grp"),
        )
    )
    total = rows.count()
    quota, extra = divmod(total, shards)
    # Written before the join: AQE splits a hot group only between plain shuffles.
    linked = rows.where("grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    linked = reliable(linked.where("members > 1"))
    marked = reliable(rows.join(linked, "grp", "left"))
    members = marked.where("members IS NOT NULL")
    label = F.pmod(F.xxhash64("doc_id", "grp"), F.lit(shards)).cast("int")
    state = members.groupBy("grp", label.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    state = reliable(propagate(state, shards, quota, rounds))

    held = loads(state, shards)
    need = [quota + (s < extra) - held[s] for s in range(shards)]
    # A group's members by number, in the order of its shards: at most one entry per shard.
    plan = reliable(state.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("plan")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(-2).alias("shard"))

    def step(seen: Column, part: Column) -> Column:
        hit = (F.col("number") >= seen["at"]) & (F.col("number") < seen["at"] + part["n"])
        shard = F.when(hit, part["shard"]).otherwise(seen["shard"])
        return F.struct((seen["at"] + part["n"]).alias("at"), shard.alias("shard"))

    placed = (
        numbered(members, ["grp"], ["doc_id"], "number", 64)
        .join(plan, "grp")
        .withColumn("shard", F.aggregate("plan", zero, step)["shard"])
        .select("doc_id", "size", "text_crc32", "shard")
    )
    placed = reliable(placed)
    single = marked.where("members IS NULL").select("doc_id", "size", "text_crc32")
    fillers = single.unionByName(placed.where("shard < 0").drop("shard"))
    filled = numbered(fillers, [], ["doc_id", "text_crc32"], "number", 4096)
    filled = filled.withColumn("shard", shard_of(F.col("number"), need)).drop("number")
    together = placed.where("shard >= 0").unionByName(filled)
    return numbered(together, ["shard"], ["doc_id", "text_crc32"], "slot", 1024).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
