"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A *run* is a stretch of words that repeats with its smallest period q, is at
least ``max(least, 2 * q)`` words long and that no neighbouring word extends.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textpass import map_texts

#: Words of the shortest run.
LEAST = 12
#: Every word of a run stands in it as often as the run has whole periods.
OCCURRENCES = 2
#: Lags below this one are scanned one by one.
SHORT = 8


def surviving_segments(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """``(start, end)`` of the segments that can hold runs.

    A word of a run stands in it at least twice.  So a word that occurs once in
    its segment is in no run of it, and splits it; the parts are looked at
    again, with their own counts, until no part changes.  All segments of one
    depth are counted together.
    """
    at = np.arange(len(ids))
    segment = np.zeros(len(ids), dtype=np.int64)
    names = int(ids.max()) + 1 if len(ids) else 1
    while len(at):
        _, inverse, counts = np.unique(segment * names + ids[at], return_inverse=True, return_counts=True)
        often = counts[inverse] >= OCCURRENCES
        at, before = at[often], segment[often]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (before[1:] != before[:-1])
        segment = np.cumsum(new) - 1
        long = np.bincount(segment, minlength=1)[segment] >= least if len(at) else new
        at, segment = at[long], segment[long]
        if often.all() and long.all():
            break
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(at) else np.array([], dtype=int)
    ends = np.r_[first[1:], len(at)] - 1
    return [(int(at[a]), int(at[b]) + 1) for a, b in zip(first, ends, strict=False)]


def doubled(names: np.ndarray, by: int) -> np.ndarray:
    """Names of twice as long stretches from the names of two that follow each other."""
    if len(names) <= by:
        return names[:0]
    return np.unique(names[:-by] * (int(names.max()) + 1) + names[by:], return_inverse=True)[1].astype(np.int64)


def stretch(w: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The places from ``low`` to ``high`` around ``at`` whose words recur ``lag`` words later."""
    high, size = at, 64
    while True:
        a, b = w[high : high + size], w[high + lag : high + lag + size]
        wrong = np.flatnonzero(a[: len(b)] != b)
        if len(wrong) or len(b) < size:
            high += int(wrong[0]) if len(wrong) else len(b)
            break
        high, size = high + size, 2 * size
    low, size = at, 64
    while low:
        start = max(0, low - size)
        wrong = np.flatnonzero(w[start:low] != w[start + lag : low + lag])
        if len(wrong):
            low = start + int(wrong[-1]) + 1
            break
        low, size = start, 2 * size
    return low, high


def scan_lags(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of one segment.

    At its period q, the words of a run recur for ``max(least, 2 * q) - q`` places in
    a row or more.  Lags from ``low`` to ``2 * low`` thus have to agree at one of the places
    that are ``step`` apart, for ``gram`` words.  Stretches of that many words
    have names (by doubling), so one comparison per place and lag decides, and
    a band of lags costs as much as two passes over the segment.  Only what
    agrees is followed word by word.  Lags go up, so a run is met first at its smallest
    period; places inside a run that a multiple of its period meets again are
    skipped.
    """
    n = len(w)
    found: dict[tuple[int, int], int] = {}
    names, length = np.unique(w, return_inverse=True)[1].astype(np.int64), 1
    low, high = 1, SHORT
    while low <= n // 2:
        # The fewest places in a row that a run of this band agrees at.
        row = min(max(least - q, q) for q in range(low, high)) if low == 1 else low
        gram = 1
        while 4 * gram <= row:
            gram *= 2
        step = row - gram + 1 if low == 1 else gram
        while length < gram:
            names, length = doubled(names, length), 2 * length
        if not len(names) or names.max() + 1 == len(names):
            break  # no stretch of this length occurs twice
        places = np.arange(0, len(names) - low, step)
        lags = np.arange(low, min(high, n // 2 + 1))
        other = places[:, None] + lags[None, :]
        inside = other < len(names)
        agree = inside & (names[places][:, None] == names[np.where(inside, other, 0)])
        p, q = (x.ravel() for x in np.nonzero(agree))
        p, q = places[p], lags[q]
        for (start, size), period in found.items():
            if size > low and len(p):
                a, b = np.searchsorted(p, (start, start + size))
                known = (q[a:b] % period == 0) & (p[a:b] + q[a:b] + gram <= start + size)
                if known.any():
                    stay = np.r_[np.ones(a, dtype=bool), ~known, np.ones(len(p) - b, dtype=bool)]
                    p, q = p[stay], q[stay]
        order = np.lexsort((p, q))
        lag, end = 0, 0
        for at, now in zip(p[order].tolist(), q[order].tolist(), strict=True):
            if now == lag and at < end:
                continue
            start, end = stretch(w, at, now)
            lag = now
            if end - start + now >= max(least, 2 * now):
                found.setdefault((start, end - start + now), now)
        low, high = high, 2 * high
    return [(start, size, period) for (start, size), period in found.items()]


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a list of words, by start and period."""
    index: dict = {}
    ids = np.array([index.setdefault(word, len(index)) for word in words], dtype=np.int64)
    found = []
    for start, end in surviving_segments(ids, least):
        found += [(start + s, length, period) for s, length, period in scan_lags(ids[start:end], least)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RUNS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
)


def periodic_runs(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are.  ``runs`` holds
    all runs of at least ``least`` words by start and period, ``collapsed`` the
    text without the words after the first period of each run, with one space
    between words.  ``prepare`` may replace the words of a row before that.

    Null and empty texts have no words, no runs and an empty text.  Rows are
    judged alone: equal rows, equal ids and null ids all stay, other columns are
    not read, an empty table gives an empty result.  Nothing is shuffled; a
    task holds one text at a time.
    """

    def make():
        def one(text: bytes | None, name) -> tuple:
            words = (text or b"").split()
            if prepare:
                words = prepare(name, words)
            runs = runs_of(words, least)
            made = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
            return len(words), made, collapsed(words, runs).decode("utf-8", "replace")

        return one

    return map_texts(docs, {"doc_id": id_col}, text_col, make, RUNS, (id_col,))


def run_summary(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the greatest one (ties: first start, least period), and digests."""
    best = F.array_max(
        F.transform(
            "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
        )
    )

    def line(r: Column) -> Column:
        return F.concat_ws(",", r["start"], r["length"], r["period"])

    start, length, period = -best["s"], best["length"], -best["p"]
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
