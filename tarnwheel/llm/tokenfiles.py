"""Binary token files: frequency-ranked ids, one to four bytes each, with control bytes apart.

A folder holds

* ``vocabulary.bin``: the ids as 32-bit numbers, the most frequent one first
  (equal counts: the smaller id first); the place of an id is its rank;
* ``part-<task>-<piece>.ids``: the documents in order, little-endian:
  four 64-bit numbers (``MAGIC``, documents, ids, data bytes); per document
  its 64-bit id, a byte that is 1 if that is null, and the 64-bit end of its ids;
  the control bytes; the data bytes;
* ``manifest``: a Parquet table with a row per file.

A rank takes as few bytes as hold it.  A control byte has the lengths of four
ranks, less one, two bits each, the first in the lowest bits.  A reader gets the lengths of
four ranks from a table of 256 rows and all places by one running sum.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwheel.session import scratch_path

from .textpass import stored
from .tokens import Memory, kept, open_tokenizer, word_encoder

MAGIC = 0x31534449_4B4F5454
HEADER = "<4Q"
#: Ids of one file, but for its last document.
FILE_IDS = 8_000_000
#: Bytes of text that a task encodes together.
CHUNK = 4 << 20
#: Lengths of the four ranks of a control byte.
LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], dtype=np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fours = np.zeros((-(-len(ranks) // 4), 4), dtype=np.uint8)
    fours.ravel()[: len(ranks)] = more
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] <= more[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` numbers again."""
    lengths = LENGTHS[control].ravel()[:n]
    places = np.cumsum(lengths, dtype=np.int64) - lengths
    data = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
    out = data[places].astype(np.uint32)
    for i in range(1, int(lengths.max()) if n else 1):
        out |= np.where(lengths > i, data[places + i], 0).astype(np.uint32) << np.uint32(8 * i)
    return out


def kind_of(size: int) -> str:
    """Type of ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose ``column`` has about ``limit`` bytes; a longer value is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum([len(v) for v in map(memoryview_of, batch.column(column))])
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def memoryview_of(value: pa.Scalar) -> memoryview:
    return memoryview(value.as_buffer() or b"")


#: Gives texts that have the same ids as those given.
Prepare = Callable[[list[bytes]], list[bytes]]


def encoded(
    docs: DataFrame, path: str, *, id_col: str, text_col: str, end_id: int | None, mark: str | None, prepare: Prepare | None
) -> DataFrame:
    """``row, doc_id, ids`` of every row, the ids as packed numbers of two or four bytes.

    A text is cut at ASCII white space, and a process encodes each different word
    once, as long as it remembers it, which is right for tokenizers that let no token reach across
    white space.
    """
    given = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )

    def run(batches):
        tokenizer = kept(f"tokenizer {path}", lambda: open_tokenizer(path))
        kind = kind_of(tokenizer.get_vocab_size(with_added_tokens=True))
        memory = kept(f"words {path} {mark}", lambda: Memory([word_encoder(tokenizer, mark)]))
        for part in by_bytes(batches, 2, CHUNK):
            texts = part.column(2).to_pylist()
            words = [t.split() for t in (prepare(texts) if prepare else texts)]
            counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ((ids, sizes),) = memory.ids([w for ws in words for w in ws])
            ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)].tolist()
            last = np.array([] if end_id is None else [end_id], dtype=kind).tobytes()
            ids, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
            packed = [ids[a * width : b * width] + last for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(packed, type=pa.binary())], names=["row", "doc_id", "ids"]
            )

    return given.mapInArrow(run, "row long, doc_id long, ids binary")


def ranked_ids(tokens: DataFrame, kind: str) -> tuple[np.ndarray, int]:
    """The ids that occur, the most frequent one first, and how many there are in all.

    Tasks count their ids and sums are shuffled; the driver gets a row per
    different id, no more than the vocabulary has.
    """

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in map(memoryview_of, batch.column(0)):
                some = np.bincount(np.frombuffer(ids, dtype=kind))
                if len(some) > len(total):
                    some, total = total, some
                total[: len(some)] += some
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    return counts["id"].to_numpy(dtype="<u4"), int(counts["n"].sum())


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def put(folder: str, name: str, content: list[bytes]) -> int:
    """Write a file in one step: under another name first, so that a lost task leaves no half file."""
    system, path = file_system(folder)
    context = TaskContext.get()
    system.create_dir(path, recursive=True)
    trial = f"{path}/_{name}.{context.taskAttemptId() if context else 'driver'}"
    with system.open_output_stream(trial) as out:
        for part in content:
            out.write(part)
    system.move(trial, f"{path}/{name}")
    return sum(map(len, content))


def writer(folder: str, kind: str, vocabulary: np.ndarray, file_ids: int):
    """Writes the rows of a task, in their order, to one or more files; a row per file."""

    def run(batches):
        rank = np.zeros(int(vocabulary.max()) + 1 if len(vocabulary) else 1, dtype=np.uint32)
        rank[vocabulary] = np.arange(len(vocabulary), dtype=np.uint32)
        task, piece = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush():
            ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
            control, data = pack(ids)
            ends = np.cumsum([len(p) for p in parts], dtype="<u8")
            numbers = np.array([n or 0 for n in names], dtype="<i8")
            nulls = np.array([n is None for n in names], dtype=np.uint8)
            name = f"part-{task:05d}-{piece:05d}.ids"
            head = struct.pack(HEADER, MAGIC, len(names), len(ids), len(data))
            size = put(folder, name, [head, numbers.tobytes(), nulls.tobytes(), ends.tobytes(), control, data])
            columns = [[task], [piece], [name], [len(names)], [len(ids)], [size]]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=MANIFEST_NAMES)

        for batch in batches:
            for name, ids in zip(batch.column(1).to_pylist(), map(memoryview_of, batch.column(2)), strict=True):
                names.append(name)
                parts.append(rank[np.frombuffer(ids, dtype=kind)])
                held += len(parts[-1])
                if held >= file_ids:
                    yield flush()
                    names, parts, held, piece = [], [], 0, piece + 1
        if names:
            yield flush()

    return run


MANIFEST_NAMES = ["task", "piece", "name", "n_docs", "n_ids", "n_bytes"]
MANIFEST = "task long, piece long, name string, n_docs long, n_ids long, n_bytes long"


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    *,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = None,
    mark: str | None = None,
    prepare: Prepare | None = None,
    file_ids: int = FILE_IDS,
) -> str:
    """Encode every whole text, write the ids in ascending order of document ids, and return the folder.

    ``tokenizer`` is the path of a file of the tokenizers library whose tokens
    never reach across white space; ``end_id`` follows the ids of each text;
    ``mark`` names a special token that may stand between words while they are encoded;
    ``prepare`` may give texts of the same ids that have fewer different words.
    The folder is a new one in the shared folder unless given; executors write there, so it has
    to be one that all of them reach.

    Null texts are empty ones.  Null ids come last.  Of rows with one id, each
    is a document of its own, in a fixed order during the run.  An empty table
    gives a vocabulary and no file.  Other columns are not read.  A task holds
    the ids of one file; a file ends with the document that fills it.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    made = encoded(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id, mark=mark, prepare=prepare)
    tokens = stored(made, "tokens")
    kind = kind_of(open_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True))
    vocabulary, total = ranked_ids(tokens, kind)
    put(folder, "vocabulary.bin", [vocabulary.tobytes()])
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")]
    tasks = max(1, math.ceil(total / file_ids))
    ordered = tokens.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(writer(folder, kind, vocabulary, file_ids), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document of a folder, from its files.

    ``start`` counts the ids of all documents before it, ``ids`` are 32-bit
    little-endian numbers.  Starts of files are running sums over the manifest,
    which has a row per file.  A task holds one file.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("task", "piece").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches):
        system, path = file_system(folder)
        with system.open_input_stream(f"{path}/vocabulary.bin") as file:
            vocabulary = np.frombuffer(file.read(), dtype="<u4")
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_stream(f"{path}/{name}") as file:
                    content = file.read()
                for part in decoded(content, vocabulary, start):
                    yield part

    spread = max(1, spark.read.parquet(f"{folder}/manifest").count())
    return files.repartition(spread).mapInArrow(run, "doc_id long, start long, ids binary")


def decoded(content: bytes, vocabulary: np.ndarray, start: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The documents of one file."""
    magic, n, total, size = struct.unpack_from(HEADER, content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEADER)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(content, dtype=kind, count=count, offset=at)
        at += found.nbytes
        return found

    names, nulls, ends = take("<i8", n), take("u1", n), take("<u8", n).astype(np.int64)
    control, data = take("u1", -(-total // 4)), take("u1", size)
    ids = vocabulary[unpack(control, data, total)].astype("<u4")
    starts = np.r_[0, ends[:-1]] if n else ends
    for a in range(0, n, rows):
        b = min(n, a + rows)
        made = [ids[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names[a:b], mask=nulls[a:b].astype(bool)),
                pa.array(starts[a:b] + start),
                pa.array(made, type=pa.binary()),
            ],
            names=["doc_id", "start", "ids"],
        )
