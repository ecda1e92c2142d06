"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.sources.tables import Tables

from . import twins
from .alignment import align_tokens
from .decontaminate import benchmark_hits
from .forest import nearest
from .licenses import license_summary, scan_licenses
from .lines import dedup_lines
from .mixing import mix, with_sizes
from .passages import near_passages
from .quality import quality_scores, with_statistics
from .runs import periodic_runs, run_summary
from .sharding import shard_documents
from .simhash import with_components, with_fingerprints
from .substrings import dedup_substrings
from .textpass import stored
from .tokenfiles import read_token_files, write_token_files
from .tokens import letters_apart

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = " ".join(sql.split())
        return fn

    return register


@query("op1_mix")
def op1(t: Tables) -> DataFrame:
    sizes = stored(with_sizes(t.documents, "doc_id", "source", "text"), "sizes")
    mixed = mix(t.documents, sizes=sizes)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_decontaminate", twins.DECONTAMINATE)
def op2(t: Tables) -> DataFrame:
    hits = benchmark_hits(t.documents, t.benchmark, {"doc_id": "doc_id"})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op3_passages")
def op3(t: Tables) -> DataFrame:
    found = near_passages(t.documents)
    return found.withColumn("n_spans", F.coalesce(F.size("spans"), F.lit(0)).cast("long")).drop("spans")


@query("op4_shard")
def op4(t: Tables) -> DataFrame:
    return shard_documents(t.documents)


@query("op5_nearest")
def op5(t: Tables) -> DataFrame:
    return nearest(t.embeddings, F.col("vec_id") % 50 == 0)


@query("op6_lines", twins.LINES)
def op6(t: Tables) -> DataFrame:
    return dedup_lines(t.documents).select("doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256")


@query("op7_licenses")
def op7(t: Tables) -> DataFrame:
    return license_summary(scan_licenses(t.documents))


@query("op8_substrings", twins.SUBSTRINGS)
def op8(t: Tables) -> DataFrame:
    return dedup_substrings(t.documents).drop("spans")


@query("op9_simhash")
def op9(t: Tables) -> DataFrame:
    found = with_components(stored(with_fingerprints(t.documents), "fingerprints"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_quality")
def op10(t: Tables) -> DataFrame:
    features = stored(with_statistics(t.documents), "features")
    return quality_scores(features, t.labels)


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by their ids, with all words from some place on repeating a stretch."""
    chosen = None if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if chosen is None or chosen % 10 or not words:
        return words
    rest, n = chosen // 10, len(words)
    start = rest % n
    period = 1 + (n - start) // (3 + rest % 8)
    return words[:start] + (words[start : start + period] * ((n - start) // period + 1))[: n - start]


@query("op11_runs", twins.RUNS)
def op11(t: Tables) -> DataFrame:
    return run_summary(periodic_runs(t.documents, prepare=made_periodic))


@query("op12_token_files")
def op12(t: Tables) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = write_token_files(t.documents, path, end_id=2, mark="<|endoftext|>", prepare=letters_apart)
    found = read_token_files(t.spark, folder)
    return found.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query("op13_alignment")
def op13(t: Tables) -> DataFrame:
    found = align_tokens(
        t.documents,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        digest=lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256)),
    )
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return found.select(*numbers, F.col("groups").alias("groups_sha256"), "n_overlaps")
