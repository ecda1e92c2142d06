"""The candidates of a forest against prefixes compared one by one, and the lookups that they take."""

from __future__ import annotations

import numpy as np
import pytest

from tarnwheel.llm import forest
from tarnwheel.llm.forest import BITS, TREES, Forest, hash_strings, unit_rows


def by_prefixes(points: np.ndarray, query: np.ndarray, least: int) -> list[int]:
    """The vectors that share a prefix of the longest common length that gives ``least``."""
    mine, theirs = hash_strings(query[None], 5)[0], hash_strings(points, 5)
    for length in range(BITS, -1, -1):
        shift = np.uint64(BITS - length)
        found = np.flatnonzero(((theirs >> shift) == (mine >> shift)).any(axis=1))
        if len(found) >= least or not length:
            return found.tolist()


@pytest.mark.parametrize("least", [1, 20, 60, 100, 200])
def test_candidates_are_those_of_the_longest_prefix(least):
    vectors = unit_rows(np.random.default_rng(least).standard_normal((110, 12)))
    points, asked = vectors[:100], np.vstack([vectors[100:], vectors[:2]])
    got = [c.tolist() for c in Forest(points, 5).candidates(asked, least)]
    assert got == [by_prefixes(points, q, least) for q in asked]


def test_prefixes_that_no_query_can_use_are_not_looked_up(monkeypatch):
    calls, search = [], np.searchsorted
    monkeypatch.setattr(forest.np, "searchsorted", lambda *a: calls.append(1) or search(*a))
    vectors = unit_rows(np.random.default_rng(1).standard_normal((300, 12)))
    list(Forest(vectors, 5).candidates(vectors[:5], 180))
    assert len(calls) < 2 * TREES * BITS / 2
