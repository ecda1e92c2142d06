"""Approximate nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.session import reliable

#: Bits of a hash string, trees, vectors of a block and queries of a chunk.
BITS, TREES, BLOCK, CHUNK = 32, 48, 512, 4096
#: A query goes up until it has seen this share of a block.
SHARE = 0.6


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def directions(size: int, seed: int) -> np.ndarray:
    """The hyperplanes of all trees for vectors of one length."""
    return np.random.default_rng([seed, size]).standard_normal((size, TREES * BITS))


def hash_strings(unit: np.ndarray, seed: int) -> np.ndarray:
    """One hash string per tree and vector as a number: bit i tells the side of the i-th hyperplane."""
    sides = (unit @ directions(unit.shape[1], seed) > 0).reshape(len(unit), TREES, BITS)
    return sides @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))


class Forest:
    """Sorted arrays of hash strings, one per tree, over the vectors of one block."""

    def __init__(self, unit: np.ndarray, seed: int):
        codes = hash_strings(unit, seed)
        self.seed, self.size = seed, len(unit)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)

    def candidates(self, unit: np.ndarray, least: int):
        """For each query the vectors that share its prefix in some tree, at the longest common length that gives ``least``.

        Every tree is descended to the longest prefix it has; then all trees go
        up together, a bit at a time, until the query has seen enough vectors.
        At length 0 it has seen all.
        """
        codes = hash_strings(unit, self.seed)
        low = np.zeros((BITS + 1, len(unit), TREES), dtype=np.int32)
        high = np.zeros_like(low)
        for length in range(BITS + 1):
            shift = np.uint64(BITS - length)
            start = (codes >> shift) << shift
            end = start + (np.uint64(1) << shift)
            for t in range(TREES):
                low[length, :, t] = np.searchsorted(self.sorted[:, t], start[:, t], "left")
                high[length, :, t] = np.searchsorted(self.sorted[:, t], end[:, t], "left")
            # Longer prefixes have no more visits, so where all queries have too few nothing is looked up.
            if ((high[length] - low[length]).sum(axis=1) < least).all():
                break
        visits = (high - low).sum(axis=2)
        by_tree = list(np.ascontiguousarray(self.order.T))
        for q in range(len(unit)):
            length = BITS
            while True:
                # Visits count a vector once per tree, so fewer visits than wanted need no look.
                while visits[length, q] < least and length:
                    length -= 1
                ranges = zip(by_tree, low[length, q].tolist(), high[length, q].tolist(), strict=True)
                seen = np.zeros(self.size, dtype=bool)
                seen[np.concatenate([order[a:b] for order, a, b in ranges])] = True
                if not length or seen.sum() >= least:
                    break
                length -= 1
            yield np.flatnonzero(seen)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


FOUND = "query_id long, vec_id long, score double"


def search_block(seed: int, k: int, share: float):
    """The k nearest of one block for each of its queries, by exact cosines of the candidates."""

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, float]] = []
        if len(index) and len(queries):
            points = unit_rows(np.stack(index["vector"].to_numpy()))
            asked = unit_rows(np.stack(queries["vector"].to_numpy()))
            ids = index["ids"].to_list()
            first = np.array([min(i) for i in ids])
            forest = Forest(points, seed)
            least = min(len(points), max(4 * k, int(np.ceil(share * len(points)))))
            seen = forest.candidates(asked, least)
            for query, vector, near in zip(queries["query_id"].to_list(), asked, seen, strict=True):
                scores = points[near] @ vector
                best = np.lexsort((first[near], -scores))[: k + 1]
                hits = [(-scores[b], i) for b in best for i in ids[near[b]] if i != query]
                rows += [(query, i, -s) for s, i in sorted(hits)[:k]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    seed: int = 5,
    share: float = SHARE,
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query row, by cosine.

    All usable vectors are indexed.  Equal vectors are one entry with its
    ``k + 1`` smallest ids, which are all that a query can return of them.
    Entries are dealt to blocks and queries to chunks by hashes, each block has
    a forest of its own, and a task searches one block for one chunk; only the
    best ``k`` of each leave it.  ``share`` trades work for recall: vectors
    without any neighbourhood structure need a large one.

    Ties go to the smaller id.  Vectors that are null, all zero, empty, or hold
    a null or non-finite component take no part, nor do rows with a null id;
    vectors of different lengths are never compared.  Of rows with equal ids and
    vectors one is indexed; a row never finds its own id.  Without candidates a
    query has no rows, and an empty table gives an empty result.
    """
    rows = reliable(
        vectors.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(vector_col).cast("array<double>").alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("query"),
        ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    )
    smallest = Window.partitionBy("vector").orderBy("id")
    entries = reliable(
        rows.select("id", "vector")
        .withColumn("place", F.row_number().over(smallest))
        .where(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.collect_list("id").alias("ids"))
    )
    asked = rows.where("query").select(F.col("id").alias("query_id"), "vector")
    blocks = max(1, -(-entries.count() // block))
    chunks = max(1, -(-asked.count() // chunk))
    length = F.size("vector").alias("length")
    index = entries.select(
        "ids",
        "vector",
        length,
        F.pmod(F.xxhash64("vector"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"),
    )
    queries = asked.select(
        "query_id",
        "vector",
        length,
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk"),
    )
    task = ["block", "chunk", "length"]
    found = index.groupBy(*task).cogroup(queries.groupBy(*task)).applyInPandas(search_block(seed, k, share), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
