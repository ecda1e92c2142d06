"""Binary token files: exact round trips, and the ids of whole texts encoded at once."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnwheel.llm import tokenfiles
from tarnwheel.llm.tokens import Memory, letters_apart, word_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
MARK = "<|endoftext|>"
ODD = [
    f"a{MARK}b {MARK} c<|startoftext|> <|endoftext {MARK[:-1]}",
    " NBSP em\u0085next\x1cfile\x1fsep \x0bvt\x0cff\r\n\ttab  two",
    "é ́alone Å ẞΣ ΟΔΟΣ ..!? it's 'S don'T x're 12²½",
    "中文　字 \U0001f600\U0001f468‍\U0001f469 ﻿​ مرحبا 가 가",
    "<| |> < | > endoftext end o f",
    "\x00nul \x7f",
]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1001])
def test_pack(n):
    rng = np.random.default_rng(n)
    numbers = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    control, data = tokenfiles.pack(numbers)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in numbers)
    again = tokenfiles.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
    assert again.tolist() == numbers.tolist()


def test_words_one_by_one_are_the_text():
    """Cutting at white space changes no id, whatever stands there."""
    rng = random.Random(1)
    tokenizer = Tokenizer.from_file(PATH)
    signs = "aAzé'sß́̊Σςͅİıǅ 　 ‍\n\t.,-<|>19²中ーがか゚\U0001f600ำเ각"
    made = ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(1500)] + ODD
    for mark in (MARK, None):
        memory = Memory([word_encoder(tokenizer, mark)], limit=50)
        for text in made:
            ((ids, sizes),) = memory.ids(text.encode().split())
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
            assert sizes.sum() == len(ids)


def read(spark, folder):
    rows = tokenfiles.read_token_files(spark, folder).collect()
    return sorted((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows)


@pytest.mark.parametrize("file_ids", [700, 8_000_000])
def test_files(spark, docs, texts, file_ids):
    odd = spark.createDataFrame([(200 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True)
    folder = tokenfiles.write_token_files(rows, PATH, end_id=2, mark=MARK, file_ids=file_ids)
    got = read(spark, folder)
    tokenizer = Tokenizer.from_file(PATH)
    wanted = [(i, t) for i, t, *_ in texts] + [(200 + i, t) for i, t in enumerate(ODD)]
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in wanted]
    assert sorted(((i, x) for (i, _), x in zip(wanted, ids)), key=repr) == sorted(((d, x) for _, d, x in got), key=repr)
    at = 0
    for start, _, x in got:
        assert start == at
        at += len(x)
    names = [d for _, d, _ in got]
    assert names == sorted(names, key=lambda d: (d is None, d or 0))
    files = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(f["n_ids"] for f in files) == at and sum(f["n_docs"] for f in files) == len(got)
    longest = max(map(len, ids))
    assert (len(files) > 10) == (file_ids == 700) and max(f["n_ids"] for f in files) < file_ids + longest
    vocabulary = np.fromfile(f"{folder.removeprefix('file://')}/vocabulary.bin", "<u4").tolist()
    counts = np.bincount(np.concatenate([np.array(x) for x in ids]))
    assert vocabulary == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))


def test_empty_table_and_no_end(spark, nothing):
    assert read(spark, tokenfiles.write_token_files(nothing, PATH)) == []
    docs = spark.createDataFrame([(3, None), (1, ""), (2, "two words")], "doc_id long, text string")
    got = read(spark, tokenfiles.write_token_files(docs, PATH))
    assert sorted((d, len(x)) for _, d, x in got) == [(1, 0), (2, 2), (3, 0)]


def made_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    signs = "aAzJHTWYéÉß×÷'s'TreLḺ̸̌̈̊́̇İIK 　 \n\t.,-_=<|>\"(1²½中ーがか゚\U0001f600각\x1c\u0085\x7f"
    return ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(4000)]


def test_letters_apart_keeps_ids():
    """Lower case and cuts change no id, and words differ less."""
    tokenizer = Tokenizer.from_file(PATH)
    given = [*made_texts(2), *ODD, "J̌ ǰ <|ENDOFTEXT|>", "Jé, (Été) l'Eau, 'Sx don'T. A.B", "", "AB"]
    found = letters_apart([t.encode() for t in given])
    memory = Memory([word_encoder(tokenizer, MARK)])
    for text, prepared in zip(given, found, strict=True):
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert tokenizer.encode(prepared.decode(), add_special_tokens=False).ids == wanted, repr(text)
        ((ids, _),) = memory.ids(prepared.split())
        assert ids.tolist() == wanted, repr(text)
    assert letters_apart([b"The end, the End (THE)"]) == [b"the end , the end ( the )"]
    assert letters_apart([]) == [] and letters_apart([b"", b"", b"A\xff,\xc3"]) == [b"", b"", b"A\xff,\xc3"]


def test_words_of_letters_go_together():
    """Also those of which one is two stretches for the tokenizer."""
    tokenizer = Tokenizer.from_file(PATH)
    words = ["one", "İ", "x,", "été", "Zz", "각", "12", "ß"]
    for chosen in (words, words[:1], ["İx", "xİ"], [w for w in words if w != "İ"], ["1", ","]):
        ids, sizes = word_encoder(tokenizer, MARK)([w.encode() for w in chosen])
        each = [tokenizer.encode(w, add_special_tokens=False).ids for w in chosen]
        assert sizes.tolist() == list(map(len, each)) and ids.tolist() == [i for x in each for i in x]


def test_memory_after_a_failure():
    """Units whose encoding failed are not taken for known ones."""
    failing = True

    def encode(units):
        if failing and b"bad" in units:
            raise ValueError
        return np.array([len(u) for u in units]), np.ones(len(units), dtype=np.int64)

    memory = Memory([encode])
    memory.ids([b"a"])
    with pytest.raises(ValueError):
        memory.ids([b"bb", b"bad"])
    failing = False
    assert memory.ids([b"a", b"bad", b"bb", b"a"])[0][0].tolist() == [1, 3, 2, 1]
