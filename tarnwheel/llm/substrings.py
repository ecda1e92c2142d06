"""Exact substring dedup: repeated byte strings by blockwise suffix sorting.

Texts are bytes.  A *window* is a string of ``WINDOW`` bytes, a *suffix* the
place where one starts.  The least hash of the ``GRAM``-byte strings inside a
window is its *anchor*: equal windows have equal anchors, so anchors cut the
suffixes into buckets, and an anchor that occurs once rules its windows out.

1. ``anchors``: tasks find the anchors of their texts; a shuffle of packed
   anchors tells which occur again.
2. ``fragments``: consecutive suffixes with one repeated anchor make a fragment,
   cut from the text with the bytes that its windows need.
3. ``sort_bucket``: buckets of fragments are suffix sorted one at a time.
   Ties of the first bytes are decided by the ranks of a difference cover
   sample, so that long repeats cost no long comparisons.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwheel.session import reliable

from .textpass import map_texts, stored

WINDOW, GRAM = 100, 24
ANCHORS = WINDOW - GRAM + 1
#: An anchor of more texts than this is not one bucket: its windows are dealt by their own hashes.
WIDE = 8192
#: Bytes of texts that are handled together inside a task.
CHUNK, CUT_CHUNK = 8 << 20, 2 << 20
#: Bytes of text per bucket of anchors, and repeated anchors per bucket of fragments.
BUCKET_BYTES, BUCKET_LINKS = 4_000_000, 4000
#: Stands for a second text that holds an anchor.
NOBODY = 0
#: Bits of a hash that hold its place, and suffixes of a block, whose places fit into them.
LOW, BLOCK = np.uint64(0xFFFF), 65_000
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, first byte highest, so that numbers sort like bytes."""
    out = data.astype(np.uint64)
    for step in (1, 2, 4):
        out = (out[:-step] << np.uint64(8 * step)) | out[step:]
    return out


def mixed(parts: list[np.ndarray], salt: np.uint64 = MIX) -> np.ndarray:
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        h = (h ^ part) * salt
        h ^= h >> np.uint64(29)
    h *= MIX2
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def anchored(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and anchors of the stretches of suffixes that share one place of their anchor.

    The low bits of a hash are replaced by its place in a block, so that of
    equal strings in a window the first is chosen: equal windows choose the
    same one, and windows that repeat at a distance choose different places.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    found = []
    for begin in range(0, len(data) - WINDOW + 1, BLOCK):
        part = data[begin : begin + BLOCK + WINDOW - 1]
        words = eights(part)
        n = len(part) - GRAM + 1
        hashes = mixed([words[i : i + n] for i in range(0, GRAM, 8)])
        least = sliding_min((hashes & ~LOW) | np.arange(n, dtype=np.uint64), ANCHORS)
        starts = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
        found.append((begin + starts, begin + np.append(starts[1:], len(least)), least[starts] & ~LOW))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[dict]]:
    """Rows in lists of at most ``limit`` bytes of text (a longer text stands alone)."""
    rows, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for row in batch.slice(start, 256).to_pylist():
                if rows and size + len(row["text"]) > limit:
                    yield rows
                    rows, size = [], 0
                rows.append(row)
                size += len(row["text"])
    if rows:
        yield rows


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    first = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)])
    return first, np.diff(np.append(first, len(sorted_values)))


def spread(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchors * MIX) >> np.uint64(20)) % np.uint64(buckets)


PACKED = T.StructType(
    [
        T.StructField("bucket", T.LongType()),
        T.StructField("known", T.BooleanType()),
        T.StructField("anchors", T.BinaryType()),
        T.StructField("texts", T.BinaryType()),
    ]
)
PACKED_ARROW = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), ("anchors", pa.binary()), ("texts", pa.binary())])


def pack_anchors(buckets: int):
    """Anchors of the texts (``id, text``), packed by bucket.

    An anchor that two places of one chunk share is known to be repeated.  All
    its texts are written as known, and only one of them and ``NOBODY`` stand
    for the chunk in the anchor's bucket, so a common passage is two entries per
    chunk.
    """

    def run(batches):
        for rows in chunks(batches, CHUNK):
            found, owners = [], []
            for ident, text in {r["id"]: r["text"] for r in rows if len(r["text"]) >= WINDOW}.items():
                anchors = anchored(text)[2]
                found.append(anchors)
                owners.append(np.full(len(anchors), ident, dtype=np.int64))
            if not found:
                continue
            anchors, texts = np.concatenate(found), np.concatenate(owners)
            order = np.argsort(anchors, kind="stable")
            anchors, texts = anchors[order], texts[order]
            first, count = runs_of(anchors)
            several = np.repeat(count > 1, count)
            again = anchors[first[count > 1]]
            lone = np.concatenate([anchors[first], again])
            out = []
            for known, a, t, b in (
                (True, anchors[several], texts[several], spread(texts[several].view(np.uint64), buckets)),
                (False, lone, np.append(texts[first], np.full(len(again), NOBODY)), spread(lone, buckets)),
            ):
                by = np.argsort(b, kind="stable")
                for at, n in zip(*runs_of(b[by]), strict=True) if len(by) else ():
                    part = by[at : at + n]
                    out.append((int(b[part[0]]), known, a[part].tobytes(), t[part].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), PACKED_ARROW, strict=True)],
                schema=PACKED_ARROW,
            )

    return run


LINK_ARROW = pa.schema([("anchor", pa.int64()), ("id", pa.int64())])


def repeated_anchors(table: pa.Table) -> pa.Table:
    """``anchor, id``: repeated anchors and the texts that hold them, from one bucket."""

    def load(known: bool, name: str) -> np.ndarray:
        parts = table.filter(pc.equal(table["known"], known))[name].to_pylist()
        return np.frombuffer(b"".join(parts), dtype=np.int64)

    anchors, texts = load(False, "anchors"), load(False, "texts")
    order = np.lexsort((texts, anchors))
    anchors, texts = anchors[order], texts[order]
    first, count = runs_of(anchors)
    # Sorted by text, so copies of one text in several chunks count once.
    again = np.repeat(texts[first] != texts[first + count - 1], count)
    columns = ((known, lone[again]) for known, lone in ((load(True, "anchors"), anchors), (load(True, "texts"), texts)))
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in columns], schema=LINK_ARROW)


PIECES = T.StructType(
    [
        T.StructField("bucket", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("doc", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)
PIECES_ARROW = pa.schema(
    [("bucket", pa.int64()), ("key", pa.binary()), ("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("data", pa.binary())]
)
#: Where one of eight bytes may start so that they tell all bytes of a window.
STEPS = [*range(0, WINDOW - 8, 8), WINDOW - 8]


def members(anchors: np.ndarray, among: list[int] | None) -> np.ndarray:
    return np.isin(anchors, np.array(among or [], dtype=np.int64).view(np.uint64))


def cut_fragments(buckets: int):
    """Fragments of the texts (``key, doc, text``) around their repeated anchors ``narrow`` and ``wide``.

    Equal fragments of one chunk leave once, as the first of them; the others
    are later copies and leave as ranges to remove, without data, joined and
    dealt by text, so that a hot fragment fills no bucket.  Windows of a
    wide anchor leave one by one as 128-bit hashes, which also choose the bucket.
    """

    def run(batches):
        for rows in chunks(batches, CUT_CHUNK):
            firsts: dict[bytes, tuple] = {}
            late: dict[bytes, list] = {}

            def offer(bucket: int, place: tuple, end: int, data: bytes) -> None:
                known = firsts.get(data)
                if known is None:
                    firsts[data] = (place, end, bucket)
                elif known[0] != place:
                    after, until = (place, end) if known[0] < place else known[:2]
                    if place < known[0]:
                        firsts[data] = (place, end, bucket)
                    ranges = late.setdefault(after[2], [])
                    if ranges and ranges[-1][0] <= after[3] <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], until)
                    else:
                        ranges.append([after[3], until])

            for row in rows:
                text, key, doc = row["text"], row["key"], row["doc"]
                base = (doc is None, doc or 0, key)
                starts, ends, anchors = anchored(text)
                narrow = np.flatnonzero(members(anchors, row["narrow"]))
                where = spread(anchors[narrow], buckets).tolist()
                for bucket, a, b in zip(where, starts[narrow].tolist(), ends[narrow].tolist(), strict=True):
                    offer(bucket, (*base, a), b + WINDOW - 1, text[a : b + WINDOW - 1])
                wide = members(anchors, row["wide"])
                if wide.any():
                    words = eights(np.frombuffer(text, dtype=np.uint8))
                    for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
                        parts = [words[a + s : b + s] for s in STEPS]
                        hashes = np.stack([mixed(parts), mixed(parts, MIX2)], axis=1)
                        dealt = (hashes[:, 0] % np.uint64(buckets)).tolist()
                        for i in range(b - a):
                            offer(dealt[i], (*base, a + i), a + i + WINDOW, hashes[i].tobytes())
            out = [
                (bucket, place[2], None if place[0] else place[1], place[3], end, data)
                for data, (place, end, bucket) in firsts.items()
            ]
            out += [
                (zlib.crc32(key) % buckets, key, None, start, end, None)
                for key, ranges in late.items()
                for start, end in ranges
            ]
            for at in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out[at : at + 50_000], strict=True), PIECES_ARROW, strict=True)],
                    schema=PIECES_ARROW,
                )

    return run


#: Difference cover modulo 7: any two places reach places of the sample together by the same step below 7.
PERIOD, COVER = 7, (0, 1, 3)
STEP = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
#: A sample rank tells 92 bytes: with a step of 6 at most it lies in the window, and the last 8 bytes complete it.
RANKED = 92
DOUBLINGS = ((7, 15), (14, 29), (28, 57), (35, RANKED))


def cover_ranks(words: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Ranks of the first ``RANKED`` bytes at the places of the cover sample, by prefix doubling.

    ``room`` has the bytes that are left in the fragment at each place.  All
    shifts are multiples of the period, so they lead from sample to sample.
    """
    at = np.arange(len(room))
    sample = np.isin(at % PERIOD, COVER)
    ranks = np.zeros(len(room), dtype=np.int64)
    places = np.flatnonzero(sample & (room >= 8))
    ranks[places] = np.unique(words[places], return_inverse=True)[1]
    for shift, length in DOUBLINGS:
        places = np.flatnonzero(sample & (room >= length))
        pair = ranks[places] << 32 | ranks[places + shift]
        ranks = np.zeros(len(room), dtype=np.int64)
        ranks[places] = np.unique(pair, return_inverse=True)[1]
    return ranks


def sort_suffixes(words: np.ndarray, ranks: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``WINDOW`` bytes, and the class of equal ones of each.

    The first eight bytes sort most.  Ties are split around a middle member of
    each, all ties at once: two suffixes compare by the sample ranks at their
    common step, then by the last eight bytes of the window.
    """
    suffixes = suffixes[np.argsort(words[suffixes], kind="stable")]
    classes = np.cumsum(np.append(0, words[suffixes][1:] != words[suffixes][:-1]))
    done = np.zeros(len(suffixes), dtype=bool)
    while True:
        first, count = runs_of(classes)
        open_runs = ~done[first] & (count > 1)
        if not open_runs.any():
            return suffixes, classes
        active = np.flatnonzero(np.repeat(open_runs, count))
        first, count = first[open_runs], count[open_runs]
        mine, pivot = suffixes[active], np.repeat(suffixes[first + count // 2], count)
        step = STEP[mine % PERIOD, pivot % PERIOD]
        a, b = ranks[mine + step], ranks[pivot + step]
        x, y = words[mine + WINDOW - 8], words[pivot + WINDOW - 8]
        side = np.where(a != b, np.where(a < b, 0, 2), np.where(x == y, 1, np.where(x < y, 0, 2)))
        order = np.lexsort((side, np.repeat(first, count)))
        suffixes[active] = mine[order]
        sides = np.ones(len(suffixes), dtype=np.int64)
        sides[active] = side[order]
        done[active] = side[order] == 1
        # New classes begin where an old one does, or where the side changes inside it.
        new = np.append(True, (classes[1:] != classes[:-1]) | (sides[1:] != sides[:-1]))
        classes = np.cumsum(new) - 1


def later_members(order: np.ndarray, classes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Marks, by suffix, those that are not the first place of their class."""
    late = np.zeros(len(place), dtype=bool)
    first, count = runs_of(classes)
    least = np.minimum.reduceat(place[order], first)
    late[order] = place[order] > np.repeat(least, count)
    return late


GONE_ARROW = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])


def sort_bucket(table: pa.Table) -> pa.Table:
    """``key, start, end``: ranges of one bucket that an earlier window covers."""
    keys, starts, ends = table["key"].to_pylist(), table["start"].to_numpy(), table["end"].to_numpy()
    data = table["data"].to_pylist()
    docs = [(d is None, d or 0) for d in table["doc"].to_pylist()]
    # Texts by id, null last, then by key: a place is the text's number and the byte.
    texts = {t: i for i, t in enumerate(sorted(set(zip(docs, keys, strict=True))))}
    base = np.array([texts[t] for t in zip(docs, keys, strict=True)], dtype=np.int64) << 40
    sizes = np.array([-1 if d is None else len(d) for d in data])
    out = [(keys[i], starts[i], ends[i]) for i in np.flatnonzero(sizes < 0)]

    hashed = np.flatnonzero(sizes == 16)
    if len(hashed):
        pairs = np.frombuffer(b"".join(data[i] for i in hashed), dtype=np.uint64).reshape(-1, 2)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        both = pairs[order]
        classes = np.cumsum(np.append(0, (both[1:] != both[:-1]).any(axis=1)))
        late = later_members(order, classes, base[hashed] + starts[hashed])
        out += [(keys[i], starts[i], ends[i]) for i in hashed[late]]

    whole = np.flatnonzero(sizes >= WINDOW)
    if len(whole):
        size = sizes[whole]
        buffer = np.frombuffer(b"".join([*(data[i] for i in whole), bytes(8)]), dtype=np.uint8)
        words = eights(buffer)[: size.sum()]
        begin = np.cumsum(size) - size
        offset = np.arange(size.sum()) - np.repeat(begin, size)
        room = np.repeat(size, size) - offset
        suffixes = np.flatnonzero(room >= WINDOW)
        place = np.repeat(base[whole] + starts[whole], size) + offset
        order, classes = sort_suffixes(words, cover_ranks(words, room), suffixes)
        late = np.zeros(len(room) + 1, dtype=bool)
        back = np.searchsorted(suffixes, order)
        late[suffixes[later_members(back, classes, place[suffixes])]] = True
        # A fragment ends with places that are no suffixes, so runs of marks never cross fragments.
        change = np.flatnonzero(np.diff(np.append(False, late).astype(np.int8)))
        for a, b in change.reshape(-1, 2):
            i = whole[np.searchsorted(begin, a, "right") - 1]
            at = starts[i] + offset[a]
            out.append((keys[i], at, at + b - a + WINDOW - 1))
    columns = zip(*out, strict=True) if out else ([], [], [])
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, GONE_ARROW, strict=True)], schema=GONE_ARROW)


RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
KEPT = T.StructType(
    [
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", RANGES),
    ]
)


def without_ranges(text: bytes, ranges: list[dict]) -> tuple:
    spans: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in ranges):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    digest, at = hashlib.sha256(), 0
    for start, end in spans:
        digest.update(text[at:start])
        at = end
    digest.update(text[at:])
    return sum(b - a for a, b in spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]


def repeated_ranges(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, doc, ranges`` of every distinct text that has ranges to remove.

    ``texts`` has ``key, owner, text`` per document, ``rows`` the same documents
    without text (``key, id, doc, n_bytes``).
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    owners = rows.where(F.col("n_bytes") >= WINDOW).groupBy("key", "id").agg(F.min("doc").alias("doc"))
    packed = texts.where(F.length("text") >= WINDOW).select("id", "text")
    packed = packed.mapInArrow(pack_anchors(max(64, total // BUCKET_BYTES)), PACKED)
    links = stored(packed.groupBy("bucket").applyInArrow(repeated_anchors, "anchor long, id long"), "anchors")
    buckets = max(64, links.count() // BUCKET_LINKS)

    # Written before the join: AQE splits a hot anchor only between plain shuffles.
    wide = reliable(links.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE))
    wanted = (
        links.join(wide, "anchor", "left")
        .groupBy("id")
        .agg(
            F.collect_list(F.when(F.col("n").isNull(), F.col("anchor"))).alias("narrow"),
            F.collect_list(F.when(F.col("n").isNotNull(), F.col("anchor"))).alias("wide"),
        )
        .join(owners, "id")
        .drop("id")
    )
    pieces = (
        texts.select("key", "owner", "text")
        .join(wanted, "key")
        .where(F.col("owner").eqNullSafe(F.col("doc")))
        .select("key", "doc", "text", "narrow", "wide")
        .mapInArrow(cut_fragments(buckets), PIECES)
    )
    gone = pieces.groupBy("bucket").applyInArrow(sort_bucket, "key binary, start long, end long")
    ranges = gone.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return ranges.join(owners.select("key", "doc"), "key")


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row.

    Every byte goes that lies in a string of ``WINDOW`` bytes which also starts
    earlier: in a document with a smaller id (null last), or before in the same
    one.  Strings are judged on the input and never cross documents.  ``spans``
    are the byte ranges to cut, sorted and apart from each other.

    Equal texts are looked at once: the text of the smallest id is judged, its
    copies go whole if they have a window at all.  Rows that are equal in id and
    text count as one after the other.  Null is an empty text; texts shorter
    than a window stay.  Ids are whole numbers; different texts with one id are
    ordered by a hash.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    made = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    made = made.withColumn("key", F.unhex(F.md5("text"))).withColumn("id", F.xxhash64("text"))
    rows = stored(
        made.select("doc", "key", "id", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")),
        "texts",
    )
    texts = made.withColumnRenamed("doc", "owner")
    ranges = repeated_ranges(texts, rows)
    judged = texts.select("key", "owner", "text").join(ranges, "key").where(F.col("owner").eqNullSafe(F.col("doc")))
    cut = map_texts(judged, {"key": "key"}, "text", lambda: without_ranges, KEPT, ("ranges",)).dropDuplicates(["key"])

    twins = Window.partitionBy("key", "doc").orderBy("sha")
    owners = rows.groupBy("key").agg(F.min("doc").alias("owner"))
    first = F.col("doc").eqNullSafe(F.col("owner")) & (F.col("twin") == 1)
    empty = hashlib.sha256(b"").hexdigest()

    def pick(short, own, copy):
        return F.when(F.col("n_bytes") < WINDOW, short).when(first, own).otherwise(copy)

    zero, none = F.lit(0).cast("long"), F.array().cast(RANGES)
    all_of_it = F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end")))
    return (
        rows.withColumn("twin", F.row_number().over(twins))
        .join(owners, "key")
        .join(cut, "key", "left")
        .withColumn("spans", pick(none, F.coalesce("spans", none), all_of_it))
        .select(
            F.col("doc").alias("doc_id"),
            "n_bytes",
            pick(zero, F.coalesce("n_removed", zero), F.col("n_bytes")).alias("n_removed"),
            F.size("spans").cast("long").alias("n_spans"),
            pick(F.col("sha"), F.coalesce("kept_sha256", "sha"), F.lit(empty)).alias("kept_sha256"),
            "spans",
        )
    )
