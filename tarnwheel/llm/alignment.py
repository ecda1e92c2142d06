"""Alignment of the tokens of two tokenizers, and how often their ids are linked in the corpus.

Both tokenizers cut the same bytes.  Their token ends are merged by *merge
path*: the path of the merge crosses each diagonal of the grid of A ends and B
ends once, at a place that a binary search finds.  So diagonals at equal
distances cut the merge into pieces of equal work that need nothing of each other.
Pieces emit the overlaps of A and B tokens; a tie that a diagonal parts, and a group
that reaches over diagonals, are put together from neighbouring pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.session import reliable

from .textpass import stored
from .tokenfiles import by_bytes, pack, unpack
from .tokens import Encoder, Memory, kept, listed, open_tokenizer

#: Ends that one piece merges.
PIECE = 1 << 15
#: Words that a process remembers.
MEMORY = 500_000
#: Bytes of text that a task aligns together.
CHUNK = 2 << 20
#: Neither tokenizer has a token that reaches over a single space between words.
CUT = r"(?<=\S) (?=\S)"
SPACE = "▁"


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two sorted arrays (ties: ``a`` first) crosses every ``piece``-th diagonal.

    The path crosses diagonal d after the first i of ``a`` and the first d - i of
    ``b``; i is the least one for which ``a[i]`` comes after ``b[d - i - 1]``.
    All diagonals are searched at once, each on its own.
    """
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        goes = open_.copy()
        goes[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low, high = np.where(goes, mid + 1, low), np.where(open_ & ~goes, mid, high)
    return low, d - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, ...]:
    """``i, j, together`` of the overlaps that end within one piece, in order; ``together``: both tokens end there.

    Each end closes the overlap of the A token and the B token that cover the byte
    before it.  A tie closes one: the A end emits it, also if its B end
    lies beyond the diagonal.
    """
    own_a, own_b = a[i0:i1], b[j0:j1]
    j_of = j0 + np.searchsorted(own_b, own_a, "left")
    tie = np.zeros(len(own_a), dtype=bool)
    inside = j_of < len(b)
    tie[inside] = b[j_of[inside]] == own_a[inside]
    i_of = i0 + np.searchsorted(own_a, own_b, "left")
    alone = np.ones(len(own_b), dtype=bool)
    inside = i_of < i1
    alone[inside] = a[i_of[inside]] != own_b[inside]
    if i0 and len(own_b):
        alone &= own_b != a[i0 - 1]  # the tie that the diagonal has parted
    i = np.concatenate([np.arange(i0, i1), i_of[alone]])
    j = np.concatenate([j_of, np.arange(j0, j1)[alone]])
    together = np.concatenate([tie, np.zeros(int(alone.sum()), dtype=bool)])
    order = np.argsort(i + j, kind="stable")
    return i[order], j[order], together[order]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, together`` of all overlaps of the tokens that end at ``a`` and at ``b`` (both rising, with one last end)."""
    i, j = diagonals(a, b, piece)
    parts = [piece_overlaps(a, b, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for.

    Printable Latin-1 signs stand for themselves, the others for the signs from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """One tokenizer: the bytes of each of its tokens, and the ids of units; units whose tokens are not their bytes have none.

    ``plain`` gives the ids and numbers of ids of units, each with a space before it.
    """

    def __init__(self, pieces: list[bytes], plain: Encoder):
        self.pieces, self.plain = pieces, plain
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.plain(units)
        wanted = [b" " + u.encode() for u in units]
        pieces = [self.pieces[i] for i in ids.tolist()]
        ends = np.cumsum(sizes)
        if b"".join(pieces) == b"".join(wanted):
            bytes_at = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            if np.array_equal(bytes_at[ends], np.cumsum([len(w) for w in wanted])):
                return ids, sizes
        good = [b"".join(pieces[e - n : e]) == w for e, n, w in zip(ends.tolist(), sizes.tolist(), wanted, strict=True)]
        return ids[np.repeat(good, sizes)], np.where(good, sizes, 0)


def byte_level(path: str) -> Tokens:
    """A byte-level tokenizer of the tokenizers library; special tokens in texts are plain text.

    Units go through as one text if none of them has white space at its limits,
    as every token ends at or before the end of its unit; their bytes tell which are whose.
    """
    tokenizer = open_tokenizer(path)
    tokenizer.encode_special_tokens = True
    byte = byte_level_bytes()
    entries = sorted(tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda e: e[1])
    pieces = [b""] * (entries[-1][1] + 1)
    for entry, i in entries:
        pieces[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)

    def plain(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if all(u and u == u.strip() for u in units):
            text = " " + " ".join(units)
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends, unit_ends = np.cumsum(lengths[ids]), np.cumsum([len(u.encode()) + 1 for u in units])
            last = np.minimum(np.searchsorted(ends, unit_ends), len(ends) - 1)
            if np.array_equal(ends[last], unit_ends):
                return ids, np.diff(np.concatenate([[-1], last]))
        return listed([e.ids for e in tokenizer.encode_batch_fast([" " + u for u in units], add_special_tokens=False)])

    return Tokens(pieces, plain)


def piece_level(path: str) -> Tokens:
    """A sentencepiece model that puts a space before the text and has bytes for unknown signs."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [
        bytes([int(n[1:-1], 16)]) if model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)
    ]
    return Tokens(pieces, lambda units: listed(model.encode(units, num_threads=1)))


class Pair:
    """Both tokenizers with one memory of units, and the decimal forms of ids before each sign of the written groups."""

    def __init__(self, path_a: str, path_b: str, limit: int = MEMORY):
        self.a, self.b = byte_level(path_a), piece_level(path_b)
        self.memory = Memory([self.a.encode, self.b.encode], limit)
        self.digits = [f"{i}{s}" for i in range(max(len(self.a.pieces), len(self.b.pieces))) for s in ",|;"]


ALIGNED = """chunk long, doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, groups string, links binary,
    pairs array<struct<a: int, b: int, n: long>>"""


def aligned(docs: DataFrame, path_a: str, path_b: str, *, id_col: str, text_col: str, chunk: int, piece: int) -> DataFrame:
    """The columns ``ALIGNED``: a row per document, and one for the ``pairs`` of ids linked in each chunk of documents.

    ``links`` are places in the pairs of the chunk, most frequent first, packed as ``pack`` does.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        cut = re.compile(CUT)
        pair = kept(f"pair {path_a} {path_b}", lambda: Pair(path_a, path_b))
        key = TaskContext.get().partitionId() << 33
        for rows in by_bytes(batches, 1, chunk):
            units = [cut.split(t) if t else [] for t in rows.column(1).to_pylist()]
            yield align_chunk(key, rows.column(0), units, pair, piece)
            key += 1

    return given.mapInArrow(run, ALIGNED)


def align_chunk(key: int, names: pa.Array, units: list[list[str]], pair: Pair, piece: int) -> pa.RecordBatch:
    def per_text(values: np.ndarray) -> np.ndarray:
        """Sums of a value per unit over the units of each text."""
        sums = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum([len(us) for us in units], dtype=np.int64)
        return np.diff(np.concatenate([[0], sums[ends]]))

    (a, size_a), (b, size_b) = pair.memory.ids([u for us in units for u in us])
    broken = per_text((size_a == 0) | (size_b == 0)) > 0
    if broken.any():
        units = [[] if bad else us for us, bad in zip(units, broken, strict=True)]
        (a, size_a), (b, size_b) = pair.memory.ids([u for us in units for u in us])
    n_a, n_b = per_text(size_a), per_text(size_b)
    ends_a, ends_b = np.cumsum(pair.a.lengths[a]), np.cumsum(pair.b.lengths[b])
    i, j, together = overlaps(ends_a, ends_b, piece)
    n_overlaps = np.bincount(np.searchsorted(np.cumsum(n_a), i, "right"), minlength=len(units))
    # Groups end where both tokens end; their ranges are the stitched cuts of all pieces.
    i, j = i[together], j[together]
    to_a, to_b = i + 1, j + 1
    from_a, from_b = np.r_[0, to_a][:-1], np.r_[0, to_b][:-1]
    text_of = np.searchsorted(np.cumsum(n_a), i, "right")
    n_groups = np.bincount(text_of, minlength=len(units))
    # Places of the tokens in the written form: the A tokens of a group, then its B tokens.
    shown = np.zeros(len(a) + len(b), dtype=np.int32)
    sign_a, sign_b = 3 * a.astype(np.int32), 3 * b.astype(np.int32)
    sign_a[i] += 1
    sign_b[j] += 2
    shown[np.arange(len(a)) + np.repeat(from_b, to_a - from_a)] = sign_a
    shown[np.arange(len(b)) + np.repeat(to_a, to_b - from_b)] = sign_b
    ends = np.cumsum(n_a + n_b).tolist()
    written = pair.digits.__getitem__
    groups = ["".join(map(written, shown[x:y].tolist()))[:-1] for x, y in zip([0, *ends], ends, strict=False)]
    # Pairs of ids, the most frequent one first.
    codes, link, counts = np.unique(a[i].astype(np.int64) << 32 | b[j], return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    cuts = np.cumsum(n_groups).tolist()
    link = place[link]
    links = [b"".join(pack(link[x:y])) for x, y in zip([0, *cuts], cuts, strict=False)]
    codes, counts = codes[order], counts[order]
    fields = [(codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int64)]
    pairs = pa.StructArray.from_arrays([pa.array(f) for f in fields], names=["a", "b", "n"])
    pairs = pa.ListArray.from_arrays(pa.array([0] * (len(units) + 1) + [len(codes)], type=pa.int32()), pairs)
    none = pa.nulls(1, pa.int64())
    columns = [
        pa.array([key] * (len(units) + 1), type=pa.int64()),
        *(pa.concat_arrays([c.cast(pa.int64()), none]) for c in (names, *map(pa.array, (n_a, n_b, n_groups, n_overlaps)))),
        pa.array([*groups, None], type=pa.string()),
        pa.array([*links, None], type=pa.binary()),
        pairs,
    ]
    fields = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "groups", "links", "pairs"]
    return pa.RecordBatch.from_arrays(columns, names=fields)


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """``a, b, total, best`` of ``a, b, n``: links of two ids in the corpus, and whether no other A id has more with that B id.

    Chunks have summed their links, so a pair has a row per chunk at most.
    """
    totals = reliable(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")))
    most = reliable(totals.groupBy("b").agg(F.max("total").alias("most")))
    return totals.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, groups string, n_links long, n_best long, count_sum long"


def score_chunk(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Looks the links of the documents of one chunk up in its pairs."""
    places = pairs["place"].to_numpy()
    total, best = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
    total[places], best[places] = pairs["total"].to_numpy(), pairs["best"].to_numpy()
    n_links = rows["n_groups"].to_numpy()
    n_best, count_sum = [], []
    for packed, n in zip(rows["links"].to_pylist(), n_links.tolist(), strict=True):
        content = np.frombuffer(packed, dtype=np.uint8)
        link = unpack(content[: -(-n // 4)], content[-(-n // 4) :], n)
        n_best.append(int(best[link].sum()))
        count_sum.append(int(total[link].sum()))
    made = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "groups"])
    for name, values in (("n_links", n_links), ("n_best", n_best), ("count_sum", count_sum)):
        made = made.append_column(name, pa.array(values, type=pa.int64()))
    return made


def align_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable | None = None,
    chunk: int = CHUNK,
    piece: int = PIECE,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_overlaps, groups, n_links, n_best, count_sum`` of every row.

    A is a byte-level tokenizer of the tokenizers library and gets a space and
    the text, B a sentencepiece model that adds the space itself.  Byte offsets
    where tokens of both end cut the tokens into groups, written as
    ``a1,a2|b1;a3|b2`` with the ids in order; ``digest`` is applied to that column
    before anything is stored.  ``n_overlaps`` counts pairs of tokens that share
    bytes.  A *link* is a pair of tokens that end together.  ``count_sum`` adds
    up, over the links, how many links of the corpus join the same two ids;
    ``n_best`` counts the links of which no other A id has more with that B id.

    Null and empty texts, and those whose tokens of A or of B, joined, are not
    the bytes of a space and the text, have no tokens: zeros and an empty
    ``groups``.  Rows are judged alone but for the counts of the corpus; equal rows,
    equal ids and null ids all stay.  Other columns are not read; an empty table gives an empty
    result.  Tasks hold one chunk of texts, or one longer text, at a time.
    """
    made = aligned(docs, path_a, path_b, id_col=id_col, text_col=text_col, chunk=chunk, piece=piece)
    if digest:
        made = made.withColumn("groups", digest(F.col("groups")))
    made = stored(made, "aligned")
    pairs = made.where("pairs IS NOT NULL AND links IS NULL").select(
        F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair")
    )
    pairs = pairs.select("of", "place", "pair.*")
    judged = pairs.join(reliable(judged_pairs(pairs)), ["a", "b"]).select("of", "place", "total", "best")
    rows = made.where("links IS NOT NULL").drop("pairs")
    return rows.groupBy("chunk").cogroup(judged.groupBy("of")).applyInArrow(score_chunk, SCORED)
