"""Token ids of whole texts from public tokenizers, word by word with a memory."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable
from itertools import islice

import numpy as np

#: Words that a memory holds before it forgets those that came once.
MEMORY = 800_000
#: Words that go to a tokenizer together.
TOGETHER = 200

#: Gives the ids of units, one after the other, and the number of ids of each.
Encoder = Callable[[list], tuple[np.ndarray, np.ndarray]]


def kept(name: str, make: Callable):
    """What ``make`` has made first in this process.

    Spark hands a Python process from task to task, while functions and their
    modules come anew with each; so what tasks share stands in a module of its own.
    """
    home = sys.modules.setdefault("tarnwheel_worker", types.ModuleType("tarnwheel_worker"))
    if name not in home.__dict__:
        home.__dict__[name] = make()
    return home.__dict__[name]


class Numbers(dict):
    """A number for every unit that is looked up, in the order of their first look-up."""

    def __missing__(self, unit):
        number = self[unit] = len(self)
        return number


class Memory:
    """Ids of units (words) that one or more encoders give, encoded once and then looked up.

    A memory of more than ``limit`` units forgets those that came once, and if
    that is not half of them all, so it is bounded however many different units occur.
    """

    def __init__(self, encoders: list[Encoder], limit: int = MEMORY):
        self.encoders, self.limit = encoders, limit
        self.index = Numbers()
        self.uses = np.zeros(1 << 12, dtype=np.uint32)
        self.flat = [np.zeros(1 << 16, dtype=np.uint16) for _ in encoders]
        self.starts = [np.zeros(1 << 12, dtype=np.uint32) for _ in encoders]
        self.sizes = [np.zeros(1 << 12, dtype=np.uint32) for _ in encoders]
        self.used = [0 for _ in encoders]

    def learn(self, first: int, units: list) -> None:
        last = first + len(units)
        for k, encode in enumerate(self.encoders):
            self.hold(k, first, *encode(units))
        self.uses = grown(self.uses, last)
        self.uses[first:last] = 0

    def hold(self, k: int, first: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        end = self.used[k] + len(ids)
        if len(ids) and int(ids.max()) > np.iinfo(self.flat[k].dtype).max:
            self.flat[k] = self.flat[k].astype(np.uint32)
        self.flat[k] = grown(self.flat[k], end)
        self.flat[k][self.used[k] : end] = ids
        for array, values in ((self.starts, self.used[k] + np.cumsum(sizes) - sizes), (self.sizes, sizes)):
            array[k] = grown(array[k], first + len(sizes))
            array[k][first : first + len(sizes)] = values
        self.used[k] = end

    def forget(self) -> None:
        often = self.uses[: len(self.index)] > 1
        if 2 * often.sum() > len(often):
            often[:] = False
        places = np.flatnonzero(often)
        self.index = Numbers(
            (u, i) for i, u in enumerate(u for u, stays in zip(self.index, often.tolist(), strict=True) if stays)
        )
        held = [self.gather(k, places) for k in range(len(self.encoders))]
        self.used = [0 for _ in self.encoders]
        for k, (ids, sizes) in enumerate(held):
            self.hold(k, 0, ids, sizes)
        self.uses[: len(places)] = 1

    def gather(self, k: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[k][which].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[k][which].astype(np.int64) - (ends - sizes), sizes)
        return self.flat[k][at + np.arange(len(at))], sizes

    def ids(self, units: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per encoder the ids of all units, one after the other, and the number of ids of each."""
        if len(self.index) > self.limit:
            self.forget()
        index, first = self.index, len(self.index)
        which = np.fromiter(map(index.__getitem__, units), dtype=np.int64, count=len(units))
        fresh = list(islice(reversed(index), len(index) - first))[::-1]
        try:
            for start in range(0, len(fresh), TOGETHER):
                self.learn(first + start, fresh[start : start + TOGETHER])
        except BaseException:  # the process may live on and use this memory again
            for unit in fresh:
                del index[unit]
            raise
        self.uses[: len(index)] += np.bincount(which, minlength=len(index)).astype(np.uint32)
        return [self.gather(k, which) for k in range(len(self.encoders))]


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, at least ``size`` long, by half as much again."""
    if len(array) >= size:
        return array
    new = np.zeros(max(size, len(array) * 3 // 2), dtype=array.dtype)
    new[: len(array)] = array
    return new


def listed(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.array([i for x in lists for i in x], dtype=np.uint32), sizes


def open_tokenizer(path: str):
    """A tokenizer of the tokenizers library; one thread, as Spark runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a stretch that the tokenizer encodes by itself; None if its ids don't tell."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
    ends[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
    return ends


def word_encoder(tokenizer, mark: str | None) -> Encoder:
    """Encodes words without special tokens, many in one string.

    Words of letters stand with spaces between them, if ids tell where a stretch
    ends and there are as many ends as words (letters give one stretch at least).
    Others stand with a special token ``mark`` between them, if there is one: the
    library cuts a text there before it does anything else, so each part is encoded as if alone.  If a word has a sign
    of the mark that is no letter, its batch goes word by word.
    """
    number = tokenizer.token_to_id(mark) if mark else None
    signs = {c for c in mark or "" if not c.isalnum()}
    ends = word_ends(tokenizer)

    def marked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if number is None or any(c in "".join(texts) for c in signs):
            return listed([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ids = np.array(tokenizer.encode_batch_fast([mark.join(texts)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cuts = np.flatnonzero(ids == number)
        return ids[ids != number], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1

    def spaced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        last = np.flatnonzero(ends[ids])
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(texts) else marked(texts)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.array([ends is not None and t.isalpha() for t in texts])
        parts = [(np.flatnonzero(which), how) for which, how in ((plain, spaced), (~plain, marked)) if which.any()]
        made = [how([texts[i] for i in at]) for at, how in parts]
        ids, sizes = (np.concatenate(x) for x in zip(*made, strict=True))
        # Back into the order of the words.
        order = np.argsort(np.concatenate([at for at, _ in parts]))
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        return ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))], sizes

    return encode


#: Of bytes: 1 is a letter, 2 another ASCII sign that is no digit, 3 the apostrophe.
KIND = np.array(
    [0 if b < 33 or b > 126 or chr(b).isdigit() else 1 if chr(b).isalpha() else 3 if b == 39 else 2 for b in range(256)],
    dtype=np.uint8,
)
#: Second bytes of the letters whose UTF-8 begins with C3.
ACCENTED = np.array([chr(b + 64).isalpha() if 128 <= b < 192 else False for b in range(256)])
#: Kinds of two neighbours, the first one times 4, between which a word is cut.
APART = np.isin(np.arange(16), [1 << 2 | 2, 1 << 2 | 3, 2 << 2 | 1])


def letters_apart(texts: list[bytes]) -> list[bytes]:
    """Texts of the same ids with fewer different words.

    For tokenizers that compose signs (NFC), then lower-case, and let no token
    reach from a letter to another ASCII sign, nor from one but the apostrophe
    to a letter: A-Z are lower-cased unless what follows could be composed with
    them, and spaces are put there.  Texts that may name a special token stay.
    """
    at = [i for i, t in enumerate(texts) if b"<|" not in t]
    data = np.frombuffer(b"\n".join([*(texts[i] for i in at), b""]), dtype=np.uint8)
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 128
    data = data + (capital.view(np.uint8) << 5)
    kind = KIND[data]
    kind[1:][(data[:-1] == 0xC3) & ACCENTED[data[1:]]] = 1
    cuts = np.flatnonzero(APART[kind[:-1] << 2 | kind[1:]]) + 1
    made = np.insert(data, cuts, 32).tobytes()
    ends = np.cumsum([len(texts[i]) + 1 for i in at], dtype=np.int64)
    ends += np.searchsorted(cuts, ends)
    out = list(texts)
    for i, start, end in zip(at, [0, *ends.tolist()], ends.tolist(), strict=False):
        out[i] = made[start : end - 1]
    return out
