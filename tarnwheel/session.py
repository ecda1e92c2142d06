"""Session settings for local runs and for clusters."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job of this package relies on.  They are runtime settings, so
# ``apply_defaults`` can add them to a session that somebody else has built.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even if that costs one more shuffle above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What a task reads is what it groups in memory, many times as large.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Folders that one task writes to at once, without sorting its rows by them.
OPEN_FOLDERS = "spark.sql.maxConcurrentOutputFileWriters"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TARGET_PARTITION_BYTES = 128 * 1024 * 1024
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Stored input per shuffle partition that AQE starts from.
INITIAL_PARTITION_BYTES = 8 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, cores: int) -> int:
    """Initial shuffle partitions: about 128 MiB each, at least one per core.

    AQE merges partitions that turn out small, but never creates more than this
    number, so it has to grow with the input.
    """
    return max(cores, math.ceil(input_bytes / TARGET_PARTITION_BYTES))


def build_session(
    app_name: str = "tarnwheel",
    master: str | None = None,
    *,
    cores: int = 8,
    input_bytes: int = 0,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    options = {
        **RUNTIME_DEFAULTS,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions_for(input_bytes, cores)),
        **(settings or {}),
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Add the runtime settings to an existing session."""
    for key, value in RUNTIME_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """Size of the files in a folder, by their listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.sum("length")).first()[0] or 0


def start_partitions(spark: SparkSession, least: int) -> None:
    """Let shuffles of this session start from ``least`` partitions, or as many as it has set.

    AQE merges those that turn out small.
    """
    wanted = str(max(least, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if spark.conf.get(INITIAL_PARTITIONS, None) != wanted:
        spark.conf.set(INITIAL_PARTITIONS, wanted)


@lru_cache(maxsize=64)
def partitions_of_folder(spark: SparkSession, folder: str) -> int:
    """Shuffle partitions to start from for the tables of a folder."""
    return math.ceil(stored_bytes(spark, folder) / INITIAL_PARTITION_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is named."""
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_DIR) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwheel-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tarnwheel-{purpose}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A runtime setting for what runs in here."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Writes in here remove the files of their shuffles when they end, which else stay until the driver collects garbage."""
    return setting(spark, SHUFFLE_CLEANUP, "true")


def stored(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it from there, or over what is in ``path``.

    The files of its shuffles go when it is written.
    """
    path = path or scratch_path(df.sparkSession, purpose)
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
