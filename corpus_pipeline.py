"""The corpus pipeline: documents in, kept and sharded documents out.

Each stage gets what the stage before it kept.  All but the last return the
columns of the documents; the last one returns where each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.llm.decontaminate import decontaminate
from tarnwheel.llm.mixing import mix, with_sizes
from tarnwheel.llm.quality import accepted
from tarnwheel.llm.sharding import shard_documents
from tarnwheel.llm.simhash import one_of_each
from tarnwheel.llm.textpass import free_name, stored, with_row
from tarnwheel.sources.tables import read_table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return accepted(docs, read_table(spark, "labels.parquet", root=sf_dir))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (SimHash of three-word shingles, at most 3 bits apart)."""
    return one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that mostly consist of them."""
    return decontaminate(docs, read_table(spark, "benchmark.parquet", root=sf_dir))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix takes it: not at all, once, or up to three times."""
    rows, row = with_row(docs, "mix")
    sizes = stored(with_sizes(rows, "doc_id", "source", "text", row), "sizes")
    times = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    copies = mix(rows, sizes=sizes).where("copies > 0").select(row, times.alias(free_name(rows, "times")))
    taken = rows.join(copies, row)
    return taken.select(*docs.columns, F.explode(copies.columns[-1])).select(docs.columns)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into 16 shards of equal counts, linked ones together."""
    return shard_documents(docs)


#: Name and function of every stage, in order.
STAGES = [
    ("quality", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", clean),
    ("mixing", weigh),
    ("sharding", place),
]
#: The classifier, the fingerprints and the knapsack have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents.parquet", root=sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
