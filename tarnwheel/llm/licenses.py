"""Search for short license notices with a few wrong letters."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textpass import alnum_words, map_texts

# The phrases whose exact places count as base places, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Notices that are searched besides.
MORE = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license", "apache"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("under the bsd license", "bsd"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
#: One wrong letter for so many letters of a notice.
LETTERS_PER_ERROR = 10


@dataclass(frozen=True)
class Notice:
    """A phrase, its allowed errors, and the seeds of which one survives any so many errors."""

    phrase: str
    label: str
    base: bool
    errors: int
    seeds: tuple[tuple[int, str], ...]


def notice(phrase: str, label: str, base: bool, letters_per_error: int) -> Notice:
    """Cut the phrase into one piece more than it may have errors (pigeonhole)."""
    errors = len(phrase) // letters_per_error
    cuts = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
    seeds = tuple((a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    return Notice(phrase, label, base, errors, seeds)


def occurrences(text: str, piece: str):
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


class Scanner:
    """Finds notices in one normalised text; patterns are compiled once per task."""

    def __init__(self, notices: list[Notice]):
        self.notices = [
            (n, regex.compile(f"(?:{n.phrase}){{e<={n.errors}}}", regex.BESTMATCH)) for n in notices
        ]

    def spans(self, text: str) -> list[tuple[int, int, int, Notice]]:
        """(start, end, errors, notice) in characters of a text with one space around every word, sorted."""
        found = []
        for n, pattern in self.notices:
            size, e = len(n.phrase), n.errors
            # A true start is at most e away from one that a surviving seed proposes.
            starts = sorted({at - offset for offset, seed in n.seeds for at in occurrences(text, seed)})
            exact = [s for s in starts if s > 0 and text[s - 1 : s + size + 1] == f" {n.phrase} "]
            found += [(s, s + size, 0, n) for s in exact]
            end = 0
            for s in starts if e else ():
                # What is left around the proposal, between the match before it and the exact places.
                at = bisect_right(exact, s)
                low = max(0, s - e, end, exact[at - 1] + size if at else 0)
                high = min(len(text), s + size + e, exact[at] if at < len(exact) else len(text))
                if high - low < size - e:
                    continue
                m = pattern.search(text, low, high)
                if m:
                    found.append((m.start(), m.end(), sum(m.fuzzy_counts), n))
                    end = m.end()
        return sorted(found, key=lambda x: (x[0], x[1], x[3].phrase))


SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("errors", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])


def scan_text(scanner: Scanner, text: bytes | None) -> tuple[int, list[dict]]:
    words = alnum_words(text or b"")
    padded = f" {b' '.join(words).decode('utf-8', 'replace')} "
    spans, seen, at = [], 0, 0
    for start, end, errors, n in scanner.spans(padded):
        start += padded[start] == " "
        seen += padded.count(" ", at, start)
        at = start
        spans.append(
            {
                "label": n.label,
                "base": n.base and errors == 0 and padded[start - 1] == " " and padded[end] == " ",
                "first_word": seen - 1,
                "n_words": padded.count(" ", start, end) + 1,
                "errors": errors,
                "score": 1 - errors / len(n.phrase),
            }
        )
    return len(words), spans


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple[tuple[str, str], ...] = BASE,
    more: tuple[tuple[str, str], ...] = MORE,
    letters_per_error: int = LETTERS_PER_ERROR,
) -> DataFrame:
    """``id_col, n_words, spans`` of every row: each place of a notice with its words, errors and score.

    A notice is cut into one seed more than it may have errors, so one seed is
    intact in every match.  The seeds are looked up exactly, and the regex
    library decides about the window around each with the bounded number of
    errors.  A place without errors between word limits is exact; only those
    of ``base`` are marked ``base``.  Places of one notice do not overlap unless they are exact: a
    stretch within the allowed errors that is not reported overlaps one that is.

    Null and empty texts have no words and no spans; rows are never dropped or
    merged, whatever their ids; other columns are not read.
    """
    notices = [notice(p, label, True, letters_per_error) for p, label in base]
    notices += [notice(p, label, False, letters_per_error) for p, label in more]

    def make():
        scanner = Scanner(notices)
        return lambda text: scan_text(scanner, text)

    return map_texts(docs, {id_col: id_col}, text_col, make, FOUND)


def license_summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per scanned row: base places, their first and last word, labels and the best score (0 without a span)."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
