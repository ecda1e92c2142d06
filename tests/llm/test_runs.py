"""Periodic runs against a plain scan of all lags."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tarnwheel.llm import queries, runs


def plain_runs(words: list, least: int) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = [rng.randrange(rng.choice([1, 2, 3, 5, 20])) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            at, period = rng.randint(0, len(words)), rng.randint(1, 40)
            words[at:at] = words[at : at + period] * rng.randint(2, 6)
        least = rng.choice([12, 12, 2, 5, 30])
        assert runs.runs_of(words, least) == plain_runs(words, least)


def test_rare_words_split_again_and_again():
    # "c" is alone only after "u" and "v" have split the text.
    words = "b c u x x x x x x x x x x x x x x c v b".split()
    ids = np.unique(words, return_inverse=True)[1].astype(np.int64)
    assert runs.surviving_segments(ids) == [(3, 17)]


def test_long_periodic_texts_are_scanned_in_few_passes():
    assert runs.runs_of([1] * 300_000) == [(0, 300_000, 1)]
    assert runs.runs_of([i % 70_000 for i in range(300_000)]) == [(0, 300_000, 70_000)]


def test_rows(docs, texts, nothing):
    got = sorted(map(tuple, runs.periodic_runs(docs).select("doc_id", "n_words", "collapsed", "runs").collect()), key=repr)
    wanted = []
    for name, text, _, _ in texts:
        words = (text or "").split()
        found = plain_runs(words, 12)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        wanted.append((name, len(words), kept, found))
    assert sorted(((a, b, c, [tuple(r) for r in d]) for a, b, c, d in got), key=repr) == sorted(wanted, key=repr)
    assert any(d for *_, d in wanted) and runs.run_summary(runs.periodic_runs(nothing)).count() == 0


def test_summary(spark):
    rows = [(1, "a b " * 8 + "z " + "c d e " * 6, ), (2, "q " * 20 + "w " * 20), (3, "one two"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.run_summary(runs.periodic_runs(docs)).collect()}
    assert tuple(got[1])[1:6] == (2, 17, 18, 3, 6000)
    assert tuple(got[2])[1:6] == (2, 0, 20, 1, 20000)  # equal lengths: the first
    assert got[1]["runs_sha256"] == hashlib.sha256(b"0,16,2\n17,18,3\n").hexdigest()
    assert got[2]["collapsed_sha256"] == hashlib.sha256(b"q w").hexdigest()
    assert tuple(got[4])[1:6] == (0, None, None, None, None) == tuple(got[3])[1:6]
    assert got[4]["collapsed_sha256"] == got[4]["runs_sha256"] == hashlib.sha256(b"").hexdigest()


def test_made_periodic():
    words = [b"%d" % i for i in range(100)]
    chosen = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert chosen
    for name in chosen:
        g = zlib.crc32(str(name).encode()) // 10
        a = g % 100
        p = 1 + (100 - a) // (3 + g % 8)
        assert queries.made_periodic(name, words) == [words[i if i < a else a + (i - a) % p] for i in range(100)]
    assert queries.made_periodic(chosen[0], []) == [] and queries.made_periodic(None, words) == words
