"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textpass import alnum_words, map_texts, stored

#: Words of the items in one automaton; it bounds what a task and a closure hold.
WORDS_PER_AUTOMATON = 500_000
#: Automata of one pass over the documents.
PER_PASS = 4
CARRIED = "__carried_text"


class Automaton:
    """Generalised suffix automaton over the words of some items.

    State arrays: ``step`` (word -> state), ``size`` (longest string) and
    ``link`` (state of the longest suffix that occurs elsewhere too).
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.size, self.link = [0], [-1]
        ends: dict[int, set[str]] = {}
        self.whole: dict[int, set[str]] = {}
        shortest = window
        for name, words in items:
            last = 0
            for word in words:
                last = self.append(last, word)
                if len(words) >= window:
                    ends.setdefault(last, set()).add(name)
            if words and len(words) < window:
                self.whole.setdefault(last, set()).add(name)
                shortest = min(shortest, len(words))
        # From long to short: what ends at a state also ends at the state of its suffixes.
        self.names = ends
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[s]
            if self.size[up] >= window and s in ends:
                ends.setdefault(up, set()).update(ends[s])
        self.shortest = shortest

    def append(self, last: int, word: bytes) -> int:
        """Add a word behind the string of ``last``; gives the state of the longer string."""
        step, size, link = self.step, self.size, self.link
        known = step[last].get(word)
        if known is not None and size[known] == size[last] + 1:
            return known
        if known is not None:
            return self.split(last, word, known)
        new = self.state({}, size[last] + 1, 0)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            target = step[at][word]
            link[new] = target if size[target] == size[at] + 1 else self.split(at, word, target)
        return new

    def split(self, at: int, word: bytes, target: int) -> int:
        """A copy of ``target`` for the strings that are one word longer than those of ``at``."""
        copy = self.state(dict(self.step[target]), self.size[at] + 1, self.link[target])
        self.link[target] = copy
        while at >= 0 and self.step[at].get(word) == target:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def state(self, step: dict[bytes, int], size: int, link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered word ranges (start, end), joined and sorted, and the items whose windows occur.

        ``length`` is the longest suffix of the words read so far that occurs
        in an item; a window ends here if it is long enough.
        """
        step, size, link, window = self.step, self.size, self.link, self.window
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        state = length = 0

        def cover(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        for i, word in enumerate(words):
            following = step[state].get(word)
            while following is None and state:
                state = link[state]
                length = size[state]
                following = step[state].get(word)
            if following is None:
                continue
            state, length = following, length + 1
            if length < self.shortest:
                continue
            at, reach = state, length
            if reach >= window:
                cover(i + 1 - window, i + 1)
                while size[link[at]] >= window:
                    at = link[at]
                names |= self.names[at]
            if self.whole:
                while at > 0:
                    if at in self.whole and size[at] <= reach:
                        cover(i + 1 - size[at], i + 1)
                        names |= self.whole[at]
                    at = link[at]
        return spans, names


def automata(items: DataFrame, id_col: str, text_col: str, window: int, limit: int):
    """Automata that each hold at most ``limit`` words; the driver reads the items one by one.

    Longer items are cut into pieces that overlap by a window less one word,
    so that no window is lost.
    """
    group: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = items.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")
    ).where("id IS NOT NULL AND text IS NOT NULL")
    for row in rows.toLocalIterator():
        words = alnum_words(bytes(row["text"]))
        for start in range(0, max(1, len(words) - window + 1), limit - window):
            piece = words[start : start + limit - 1]
            if group and size + len(piece) > limit:
                yield Automaton(group, window)
                group, size = [], 0
            group.append((row["id"], piece))
            size += len(piece)
    yield Automaton(group, window)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", SPANS),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    keep: dict[str, str],
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    words_per_automaton: int = WORDS_PER_AUTOMATON,
    each: Callable[[bytes | None, list[tuple[int, int]], int], tuple] | None = None,
    more: tuple[T.StructField, ...] = (),
) -> DataFrame:
    """``keep`` (new names of columns), ``n_words``, covered word ``spans`` and ``items`` of every row of ``docs``.

    The automata of the items go to the tasks with the function.  Each holds at
    most ``words_per_automaton`` words and a pass over the documents takes at
    most ``PER_PASS`` of them, so what a task or the driver holds is bounded; a
    larger benchmark takes more passes, with the table written in between.
    Documents are streamed, not shuffled.

    An item of fewer words than a window is one window; an item without words,
    or with a null id or text, is none.  Null and empty documents have no words,
    spans and items.  Rows with equal ids or texts are handled alike.  ``each``
    adds columns ``more`` made from a text, its spans and its number of words.
    """
    pending = automata(items, item_id, item_text, window, words_per_automaton)
    group = list(islice(pending, PER_PASS))
    frame, columns, text, known = docs, dict(keep), text_col, ()
    while following := list(islice(pending, PER_PASS)):
        columns[CARRIED] = text
        frame = stored(map_texts(frame, columns, text, scanner(group), FOUND, known), "hits")
        columns, text, known = {c: c for c in columns}, CARRIED, ("spans", "items")
        group = following
    columns.pop(CARRIED, None)
    schema = T.StructType(FOUND.fields + list(more))
    return map_texts(frame, columns, text, scanner(group, each), schema, known)


def scanner(chains: list[Automaton], each: Callable | None = None) -> Callable:
    """Makes the function that adds what some automata find in a text to what is known of it."""

    def one(text: bytes | None, spans: list[dict] | None = None, items: list[str] | None = None) -> tuple:
        words = alnum_words(text or b"")
        found, names = [(s["start"], s["end"]) for s in spans or ()], set(items or ())
        for chain in chains:
            covered, named = chain.scan(words)
            found, names = found + covered, names | named
        found = merged(found)
        made = [{"start": a, "end": b} for a, b in found]
        return (len(words), made, sorted(names), *(each(text, found, len(words)) if each else ()))

    return lambda: one


def without_spans(text: bytes | None, spans: list[tuple[int, int]], n_words: int) -> tuple[str | None, float]:
    """The text without the covered words and what stands between them, and the covered share."""
    if not spans:
        return None if text is None else text.decode("utf-8", "replace"), 0.0
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    kept.append(text[at:])
    return b"".join(kept).decode("utf-8", "replace"), sum(b - a for a, b in spans) / n_words


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    window: int = 10,
    max_coverage: float = 0.5,
    chars_col: str | None = "n_chars",
) -> DataFrame:
    """The documents without the passages of the items, in their own columns.

    A run of words that matches over the length limit (``window``) is cut out;
    a document of which more than ``max_coverage`` is covered goes as a whole.
    ``chars_col``, if there, follows the new text.  Null and empty texts stay.
    """
    others = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c != text_col}
    made = benchmark_hits(
        docs,
        items,
        {name: c for c, name in others.items()},
        text_col=text_col,
        window=window,
        each=without_spans,
        more=(T.StructField("__clean", T.StringType()), T.StructField("__share", T.DoubleType())),
    )
    hit = F.col("__share") > 0
    columns = []
    for field in docs.schema.fields:
        if field.name == text_col:
            columns.append(F.col("__clean").alias(text_col))
        elif field.name == chars_col:
            length = F.length("__clean").cast(field.dataType)
            columns.append(F.when(hit, length).otherwise(F.col(others[chars_col])).alias(chars_col))
        else:
            columns.append(F.col(others[field.name]).alias(field.name))
    return made.where(F.col("__share") <= F.lit(max_coverage)).select(*columns)
