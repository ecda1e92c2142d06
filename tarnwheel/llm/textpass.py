"""One pass over whole texts inside tasks, and small helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.session import scratch_path, stored

#: A-Z to a-z; all other bytes are kept.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lower case, and a space for every ASCII byte that is neither a digit nor a letter.
ALNUM = bytes(
    LOWER[b] if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)
#: Rows of one result batch.
ROWS = 512


def alnum_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text."""
    return text.translate(LOWER).split()


def map_texts(
    docs: DataFrame,
    columns: dict[str, str | Column],
    text: str | Column,
    make: Callable[[], Callable[..., tuple]],
    schema: T.StructType,
    inputs: tuple[str, ...] = (),
) -> DataFrame:
    """``columns`` of every row, and what ``make()`` returns for its text.

    ``make`` is called once per task and gives a function of the text as bytes
    (None for null) and of the values of the columns ``inputs``.  Texts go through in Arrow batches and are handled one by
    one, so a task holds one batch; only the named columns are read.
    """
    names = list(columns)
    given = [f"__input_{i}_{len(''.join(names))}" for i in range(len(inputs) + 1)]  # like no column's name
    chosen = docs.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()],
        (F.col(text) if isinstance(text, str) else text).cast("string").cast("binary").alias(given[0]),
        *[F.col(c).alias(n) for c, n in zip(inputs, given[1:], strict=True)],
    )
    kept = T.StructType(chosen.schema.fields[: len(names)])
    out = T.StructType(kept.fields + schema.fields)
    types = [(f.name, to_arrow(f.dataType)) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                values = [c.to_pylist() for c in part.columns[len(names) :]]
                rows = [each(*row) for row in zip(*values, strict=True)]
                made = [pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(types)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], *made], names=[*names, *(n for n, _ in types)]
                )

    return chosen.mapInArrow(run, out)


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
    }[type(kind)]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if the frame has such a column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def with_row(docs: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """The documents with a number for every row, written once so that it stays, and the name of that column."""
    row = free_name(docs, "row_number")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), purpose), row
