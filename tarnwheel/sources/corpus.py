"""The corpus of questions: JSON files with a list of question records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import open_registry

DEFAULT_CORPUS = "select"

# The datasets are a map: inferred as a struct they would get one field per table name.
QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField(
            "datasets",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [T.StructField("file_name", T.StringType()), T.StructField("format", T.StringType())]
                ),
            ),
        ),
        T.StructField("gold_code", T.StringType()),
    ]
)
CORPUS = T.StructType([T.StructField("questions", T.ArrayType(QUESTION))])


def corpus_path(registry: Mapping[str, str], name: str | None = None) -> str:
    """Path of a named corpus; ``select`` if no name is given."""
    name = name or DEFAULT_CORPUS
    if name not in registry:
        raise ValueError(f"unknown corpus {name!r}; there are {', '.join(sorted(registry))}")
    return registry[name]


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question."""
    files = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    return files.select(F.explode("questions").alias("q")).select("q.*")


def write_corpus(questions: DataFrame, path: str, bucket: Column) -> None:
    """Write questions as JSON files ``{"questions": [...]}``, one per value of ``bucket``, which has to bound their number."""
    one = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in QUESTION])
    files = questions.groupBy(bucket.alias("bucket")).agg(F.collect_list(one).alias("questions"))
    document = F.to_json(F.struct("questions")).alias("value")
    files.select("bucket", document).write.mode("overwrite").partitionBy("bucket").text(path)


def inline_table(
    spark: SparkSession, data: Mapping[str, Sequence] | Sequence[Mapping], schema: T.StructType | str
) -> DataFrame:
    """A small table given as columns or as rows; a value that a row does not have is null.

    Columns of unequal length and names that the schema does not have are errors.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if isinstance(data, Mapping):
        given, rows = set(data), list(zip(*[data.get(n, []) for n in fields.names], strict=True))
    else:
        given, rows = {n for row in data for n in row}, [tuple(row.get(n) for n in fields.names) for row in data]
    if given - set(fields.names):
        raise ValueError(f"columns without a type: {', '.join(sorted(given - set(fields.names)))}")
    return spark.createDataFrame(rows, fields)


def open_question(spark: SparkSession, question: Row, root: str | None = None) -> dict[str, DataFrame]:
    """Open the datasets of one question and bind them to temp views."""
    datasets = {name: entry.asDict() for name, entry in question["datasets"].items()}
    return open_registry(spark, datasets, root=root)
