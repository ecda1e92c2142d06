"""SimHash near-duplicates: fingerprints, pigeonring candidates, components."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.session import reliable

from .components import components
from .textpass import map_texts, space_words, stored, with_row

SEED = 42
#: The ring: four segments of 16 bits; at most three bits may differ.
SEGMENTS, WIDTH, RADIUS = 4, 16, 3
#: Fingerprints that share a key are paired directly up to so many; all others go by their neighbourhoods.
PAIRED = 64
#: Neighbourhood entries of one task.
ENTRIES = 500_000
ROWS = 8192


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes; 0 without words."""
    words = space_words(text or b"")
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], ends[shingle - 1 :], strict=False) if len(words) > shingle else [(0, len(joined) + 1)]
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), ROWS):
        part = hashes[start : start + ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; null and empty texts have fingerprint 0."""
    return map_texts(
        docs,
        {"doc_id": id_col},
        text_col,
        lambda: fingerprint_or_zero,
        T.StructType([T.StructField("fp", T.LongType())]),
    )


def fingerprint_or_zero(text: bytes | None) -> tuple[int]:
    return (fingerprint(text),)


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def chain_holds(a: Column, b: Column, start: Column) -> Column:
    """Whether the segments from ``start`` on, added up one by one, stay within their parts of the radius.

    If at most 3 bits differ, some start has at most 3 * l / 4 differing bits in
    its first l segments for every l: none, one, two and three.
    """
    differ = a.bitwiseXOR(b)
    out = F.lit(False)
    for i in range(SEGMENTS):
        total, good = F.lit(0), F.lit(True)
        for length in range(1, SEGMENTS + 1):
            total = total + F.bit_count(segment(differ, i + length - 1))
            good = good & (total <= RADIUS * length // SEGMENTS)
        out = out | ((start == i) & good)
    return out


def keys_of(fp: Column, family: Column) -> Column:
    """Eight keys: a segment, and one half of the next segment; fingerprints of different families share none.

    A chain of two segments has no difference in the first and one at most in
    the second, so one half of the second is equal as well.
    """
    keys = []
    for i in range(SEGMENTS):
        for half in range(2):
            part = F.shiftrightunsigned(segment(fp, i + 1), 8 * half).bitwiseAND(F.lit(0xFF))
            tag = F.shiftleft(family.cast("long") * 8 + (2 * i + half), 24)
            keys.append(tag.bitwiseOR(F.shiftleft(segment(fp, i), 8)).bitwiseOR(part))
    return F.array(*keys)


FLIPS = np.uint64(1) << np.arange(64, dtype=np.uint64)
PAIR_FLIPS = np.array([FLIPS[i] | FLIPS[j] for i in range(64) for j in range(i)], dtype=np.uint64)
#: Changes of no bit or one, and of two bits.
NEAR, FAR = np.concatenate([[np.uint64(0)], FLIPS]), PAIR_FLIPS


def neighbourhoods(parts: int):
    """The points up to two bits away from each fingerprint, packed by the task they go to."""

    def run(frames):
        for frame in frames:
            fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for start in range(0, len(fps), 512):
                some = fps[start : start + 512]
                for near, changes in ((True, NEAR), (False, FAR)):
                    points = (some[:, None] ^ changes[None, :]).ravel()
                    owners = np.repeat(some, len(changes))
                    spread = points * np.uint64(0x9E3779B97F4A7C15)
                    task = (spread >> np.uint64(40)) % np.uint64(parts)
                    for t in np.unique(task):
                        chosen = task == t
                        yield pd.DataFrame(
                            {
                                "task": [int(t)],
                                "near": [near],
                                "points": [points[chosen].tobytes()],
                                "owners": [owners[chosen].tobytes()],
                            }
                        )

    return run


def meetings(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of all fingerprints that meet at a point: one is at most one bit away from it, the other at most two.

    All that are one bit away are within two bits of each other, so each point
    links its visitors to one of these; a chain of links replaces the pairs.
    """

    def load(near: bool, name: str) -> np.ndarray:
        return np.frombuffer(b"".join(frame.loc[frame["near"] == near, name]), dtype=np.uint64)

    points, owners = load(True, "points"), load(True, "owners")
    order = np.lexsort((owners, points))
    points, owners = points[order], owners[order]
    first = np.ones(len(points), dtype=bool)
    first[1:] = points[1:] != points[:-1]
    centres, centre_owner = points[first], owners[first]
    links = [np.stack([owners, centre_owner[np.cumsum(first) - 1]])]
    far_points, far_owners = load(False, "points"), load(False, "owners")
    at = np.searchsorted(centres, far_points)
    met = (at < len(centres)) & (centres[np.minimum(at, len(centres) - 1)] == far_points)
    links.append(np.stack([far_owners[met], centre_owner[at[met]]]))
    u, v = np.concatenate(links, axis=1)
    return pd.DataFrame(spanning(u, v), columns=["u", "v"])


def spanning(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """At most one link per node with the same components as the given links."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    linked = label != np.arange(len(nodes))
    return np.stack([nodes[linked], nodes[label[linked]]], axis=1).view(np.int64)


def near_links(fps: DataFrame) -> DataFrame:
    """``u, v``: links between different fingerprints (one row per ``fp``) with the components of all that differ in at most 3 bits.

    Fingerprints that share a key are candidates, pass the chain test and then
    the full distance.  Keys of more than ``PAIRED`` fingerprints are not
    paired: all their fingerprints meet at points between them instead, work
    that grows with their number and not with its square.  With a column
    ``family``, only fingerprints of one family are candidates.
    """
    family = F.col("family") if "family" in fps.columns else F.lit(0)
    keyed = fps.select("fp", F.posexplode(keys_of(F.col("fp"), family)).alias("place", "key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = reliable(keyed.join(counts, "key").select("fp", "key", (F.col("place") / 2).cast("int").alias("start"), "n"))
    few = shared.where(F.col("n") <= PAIRED)
    left, right = few.select("key", "start", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    u, v = F.col("u"), F.col("v")
    direct = (
        left.join(right, "key")
        .where((u < v) & chain_holds(u, v, F.col("start")) & (F.bit_count(u.bitwiseXOR(v)) <= RADIUS))
        .select("u", "v")
        .distinct()
    )
    hot = reliable(shared.where(F.col("n") > PAIRED).select("fp").distinct())
    many = hot.count()
    if not many:
        return direct
    tasks = max(40, -(-many * (len(NEAR) + len(FAR)) // ENTRIES))
    packed = hot.mapInPandas(neighbourhoods(tasks), "task long, near boolean, points binary, owners binary")
    return direct.unionByName(packed.groupBy("task").applyInPandas(meetings, "u long, v long"))


def class_components(fingerprints: DataFrame) -> DataFrame:
    """``fp, component_id`` of every fingerprint that occurs in ``doc_id, fp``."""
    classes = reliable(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(near_links(classes.select("fp")))
    rooted = classes.join(found.select(F.col("u").alias("fp"), F.col("v").alias("top")), "fp", "left")
    rooted = reliable(rooted.withColumn("top", F.coalesce("top", "fp")))
    least = reliable(rooted.groupBy("top").agg(F.min("least").alias("component_id")))
    return rooted.join(least, "top").select("fp", "component_id", "top")


def with_components(fingerprints: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``doc_id, fp``.

    Rows with one fingerprint are one class; classes at a distance of 3 bits or
    less are linked, and ``component_id`` is the smallest ``doc_id`` that can be
    reached.  A null id never is that smallest one (a component of null ids only
    has a null).  Equal rows all stay.  An empty table gives an empty result.
    """
    return fingerprints.join(class_components(fingerprints), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays (null last).

    Near-duplicates are those of ``with_components``: texts whose fingerprints
    (three-word shingles) differ in at most 3 bits, and what such links reach.  Texts
    without words have fingerprint zero and are one class.  Of rows with equal ids in
    one component one stays, which one is arbitrary.  Ids are whole numbers; all
    columns of the rows that stay are kept, an empty table stays empty.
    """
    rows, row = with_row(docs, "rows")
    prints = stored(
        map_texts(
            rows,
            {"doc_id": F.col(id_col).cast("long"), "row": row},
            text_col,
            lambda: fingerprint_or_zero,
            T.StructType([T.StructField("fp", T.LongType())]),
        ),
        "fingerprints",
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    firsts = reliable(prints.groupBy("fp").agg(F.min(place).alias("first")))
    tops = class_components(prints).select("fp", "top")
    chosen = firsts.join(tops, "fp").groupBy("top").agg(F.min("first").alias("first"))
    return rows.join(chosen.select(F.col("first.row").alias(row)), row, "left_semi").select(docs.columns)
