"""Text event records.

A record is an ``event:`` line and one or more ``data:`` lines; a blank line ends
it.  Both readers below let Spark split the text at the blank lines, so a large
file is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.session import OPEN_FOLDERS, setting

SEPARATOR = "\n\n"
DEFAULT_EVENT = "message"

ANSWER = T.StructType(
    [
        T.StructField("submission_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField(
            "generated_answer",
            T.StructType(
                [
                    T.StructField("code", T.StringType()),
                    T.StructField("generation_duration_seconds", T.DoubleType()),
                    T.StructField("peak_ram_mb", T.DoubleType()),
                    T.StructField("peak_gpu_mb", T.DoubleType()),
                ]
            ),
        ),
        T.StructField(
            "executed_answer",
            T.StructType(
                [
                    T.StructField("success", T.BooleanType()),
                    T.StructField("exact_match", T.BooleanType()),
                    T.StructField("execution_duration_seconds", T.DoubleType()),
                    T.StructField("generated_hash", T.StringType()),
                    T.StructField("gold_hash", T.StringType()),
                ]
            ),
        ),
    ]
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", SEPARATOR).text(path)


def stream_records(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.option("lineSep", SEPARATOR)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


# Lines end at "\n" only; blanks around the text of a field do not count.
EVENT_LINE = r"(?dm)^event:[^\S\n]*(.*)$"
DATA_LINE = r"(?dm)^data:[^\S\n]*(.*)$"
BLANKS = " \t\r\f"


def parse_records(records: DataFrame, schema: T.StructType = ANSWER, column: str = "value") -> DataFrame:
    """Add ``event``, ``raw`` and ``data``; records without a data line are dropped.

    The last event line counts, and several data lines are one text.  Where the
    text is not JSON the fields of ``data`` are null; ``raw`` always keeps it.
    """
    named = F.try_element_at(F.regexp_extract_all(column, F.lit(EVENT_LINE), F.lit(1)), F.lit(-1))
    held = F.transform(
        F.regexp_extract_all(column, F.lit(DATA_LINE), F.lit(1)), lambda line: F.rtrim(line, F.lit(BLANKS))
    )
    return (
        records.where(F.col(column).rlike("(?dm)^data:"))
        .withColumns(
            {
                "event": F.coalesce(F.rtrim(named, F.lit(BLANKS)), F.lit(DEFAULT_EVENT)),
                "raw": F.array_join(held, "\n"),
            }
        )
        .withColumn("data", F.from_json("raw", schema))
    )


def format_record(event: Column, payload: Column) -> Column:
    """The text of a record without the blank line that ends it."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload))


#: Records of one packed file, which one task reads.
PER_FILE = 100_000
#: Folders that a task writes to without sorting; if there are more it sorts.
FOLDERS = 8


def write_records(records: DataFrame, path: str, *folders: str, packed: bool = False) -> None:
    """Write one text column as records, in a folder per value of the columns ``folders`` if there are any.

    ``packed`` files are compressed and of ``PER_FILE`` records at most, as they cannot be split.  A task has files of
    several folders open at once, so that it does not sort its records by them.
    """
    writer = records.write.mode("overwrite").option("lineSep", SEPARATOR).partitionBy(*folders)
    if packed:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", PER_FILE)
    with setting(records.sparkSession, OPEN_FOLDERS, str(FOLDERS)):
        writer.text(path)
