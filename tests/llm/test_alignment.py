"""Alignment of two tokenizers against a plain walk over all tokens."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from tarnwheel.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NUMBERS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "n_overlaps"]


def whole_text_tokens(texts: list[str]) -> list[tuple[list, list]]:
    """Per text the ``(id, bytes)`` of both tokenizers, each text encoded at once."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    names = {i: n for n, i in json.load(open(A))["model"]["vocab"].items()}
    level = alignment.byte_level_bytes()
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    made = []
    for text in texts:
        a = [(i, bytes(level[c] for c in names[i])) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in second.encode(text):
            name = second.id_to_piece(i)
            b.append((i, bytes.fromhex(name[3:5]) if second.is_byte(i) else name.replace("▁", " ").encode()))
        whole = b" " + text.encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        made.append((a, b))
    return made


def plain(docs: list[tuple]) -> list[tuple]:
    tokens = whole_text_tokens([t or "" for _, t in docs])
    counts: Counter = Counter()
    found = []
    for a, b in tokens:
        i = j = end_a = end_b = 0
        groups, links, mine, yours, n_overlaps = [], [], [], [], 0
        if a:
            end_a, end_b = len(a[0][1]), len(b[0][1])
            mine, yours = [a[0][0]], [b[0][0]]
        while i < len(a):
            n_overlaps += 1
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                links.append((a[i][0], b[j][0]))
                groups.append(f"{','.join(map(str, mine))}|{','.join(map(str, yours))}")
                mine, yours = [], []
            if step_a:
                i += 1
                if i < len(a):
                    end_a += len(a[i][1])
                    mine.append(a[i][0])
            if step_b:
                j += 1
                if j < len(b):
                    end_b += len(b[j][1])
                    yours.append(b[j][0])
        counts.update(links)
        found.append((groups, links, n_overlaps))
    most: dict = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (
            doc, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
            sum(counts[x] for x in links), ";".join(groups), n_overlaps,
        )
        for (doc, _), (a, b), (groups, links, n_overlaps) in zip(docs, tokens, found, strict=True)
    ]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 1 << 15])
def test_merge_path(piece):
    rng = random.Random(piece)
    for _ in range(200):
        last = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, last + 1), rng.randint(0, last)), last})) for _ in range(2))
        wanted = [
            (i, j, a[i] == b[j])
            for i in range(len(a))
            for j in range(len(b))
            if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(a[i], b[j])
        ]
        i, j, together = alignment.overlaps(a, b, piece)
        assert list(zip(i, j, together, strict=True)) == wanted
        x, y = alignment.diagonals(a, b, piece)
        assert all(np.diff(x + y)[:-1] == piece) and (x[-1], y[-1]) == (len(a), len(b))


def test_bytes_of_the_byte_level():
    for entry in ("Ġhello", "Ċ", "Ã©"):
        known = decoders.ByteLevel().decode([entry]).encode()
        assert bytes(alignment.byte_level_bytes()[c] for c in entry) == known


ODD = [
    "<|endoftext|> <s>a</s> <unk><0x41> <pad>", "  two  spaces   three \n\n new\n line \t tab", " \n", "▁a b", "a ▁",
    "x   y　z \x85w \x1cq", "中文 字 \U0001f600\U0001f468‍\U0001f469 é ́ x", "\x00nul \x01", "'s don't I'LL x", " ", "a",
]


def test_units_are_the_text():
    """Cutting at single spaces changes no token, whatever stands beside them."""
    rng = random.Random(2)
    signs = "ab's 12 .-<|> \n\t  　​é́ß中\U0001f600ำ  the"
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 50))) for _ in range(1500)] + ODD
    memory = alignment.Pair(A, B, limit=200).memory
    for text, (a, b) in zip(texts, whole_text_tokens(texts), strict=True):
        units = alignment.re.split(alignment.CUT, text)
        (ids_a, sizes_a), (ids_b, sizes_b) = memory.ids(units)
        if a:
            assert ids_a.tolist() == [i for i, _ in a] and ids_b.tolist() == [i for i, _ in b], repr(text)
        else:
            assert (sizes_a == 0).any() or (sizes_b == 0).any(), repr(text)


@pytest.mark.parametrize(("chunk", "piece"), [(alignment.CHUNK, alignment.PIECE), (3000, 5)])
def test_documents(spark, docs, texts, chunk, piece):
    odd = spark.createDataFrame([(300 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True)
    wanted = plain([(i, t) for i, t, *_ in texts] + [(300 + i, t) for i, t in enumerate(ODD)])
    got = [tuple(r) for r in alignment.align_tokens(rows, A, B, chunk=chunk, piece=piece).select(NUMBERS).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert sum(not r[1] for r in wanted) >= 6 and any(0 < r[5] < r[4] for r in wanted)


def test_no_documents(spark, nothing):
    assert alignment.align_tokens(nothing, A, B).count() == 0
    none = spark.createDataFrame([(1, None), (1, ""), (None, None)], "doc_id long, text string")
    got = [tuple(r) for r in alignment.align_tokens(none, A, B).select(NUMBERS).collect()]
    assert sorted(got, key=repr) == sorted([(d, 0, 0, 0, 0, 0, 0, "", 0) for d in (1, 1, None)], key=repr)
