"""Each operator against brute force on a small corpus with all kinds of odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from brute import alnum, spaced
from tarnwheel.llm import decontaminate, forest, licenses, lines, mixing, passages, quality, sharding, simhash, substrings


def rows_of(frame) -> Counter:
    return Counter(tuple(r) for r in frame.collect())


def water_level(sizes: dict, weights: dict, repeats: int) -> dict:
    budget, capped = sum(sizes.values()), set()
    while True:
        left = budget - sum(repeats * sizes[s] for s in capped)
        total = sum(weights[s] for s in sizes if s not in capped)
        targets = {s: repeats * sizes[s] if s in capped else left * weights[s] / total for s in sizes}
        over = {s for s in sizes if s not in capped and targets[s] > repeats * sizes[s]}
        if not over:
            return targets
        capped |= over


def test_mix(docs, texts):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source in texts:
        sizes[source] += len(spaced(text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    targets = water_level(dict(sizes), {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    for source in sizes:
        # A source of few documents may have no nearer sum than one of its long ones.
        longest = max(len(spaced(t)) for _, t, _, s in texts if s == source)
        assert abs(taken[source] - targets[source]) <= max(2, longest / 2)
    assert rows_of(mixing.mix(docs.repartition(5))) == rows_of(mixing.mix(docs))


@pytest.mark.parametrize("times", [1, 3])
def test_budget_is_met_exactly_where_possible(times):
    rng = np.random.default_rng(times)
    for _ in range(40):
        sizes = sorted(rng.choice(np.arange(1, 40), size=5, replace=False).tolist())
        counts = rng.integers(1, 6, size=5).tolist()
        budget = int(rng.integers(0, sum(s * c for s, c in zip(sizes, counts)) + 1))
        made = mixing.fit_budget(sizes, counts, budget, times)
        reachable = {0}
        for s, c in zip(sizes, counts):
            reachable = {r + s * k for r in reachable for k in range(c * times + 1)}
        assert all(0 <= k <= c * times for k, c in zip(made, counts))
        best = min(abs(r - budget) for r in reachable)
        assert abs(sum(s * k for s, k in zip(sizes, made)) - budget) <= best + 3


def brute_hits(text, items):
    doc, hit, found = alnum(text), set(), set()
    for name, item in items:
        ws = alnum(item)
        n = min(len(ws), 10)
        windows = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1):
            if n and tuple(doc[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize(("limit", "per_pass"), [(500_000, 4), (25, 4), (25, 1)])
def test_benchmark_hits(docs, texts, benchmark, limit, per_pass, monkeypatch):
    monkeypatch.setattr(decontaminate, "PER_PASS", per_pass)
    items = [tuple(r) for r in benchmark.collect() if r[0] is not None and r[1] is not None]
    got = decontaminate.benchmark_hits(docs, benchmark, {"doc_id": "doc_id"}, words_per_automaton=limit)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    made = rows_of(got.select("doc_id", "n_words", n_hit, F.array_join("items", ",")))
    want = Counter()
    for ident, text, *_ in texts:
        n, hit, found = brute_hits(text, items)
        want[(ident, n, hit, ",".join(found))] += 1
    assert made == want


def test_decontaminate_cuts_and_drops(docs, texts, benchmark):
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.schema == docs.schema
    after = {r["doc_id"]: r for r in clean.collect() if r["doc_id"] is not None}
    assert 9 not in after and 100 not in after  # item 7 is all of 9, item 6 all of 100
    assert 168 in after and after[167]["text"] is None
    assert "elease" not in after[166]["text"] and after[166]["n_chars"] == len(after[166]["text"])
    assert after[161]["text"] == texts[57][1] or after[161]["n_chars"] >= 9000


def test_passages_link_repeats_and_leave_the_rest(docs, texts):
    got = passages.near_passages(docs).collect()
    assert len(got) == len(texts)
    classes = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert {classes[100 + i] for i in range(8)} == {100}
    assert classes[162] == 161 and {classes[140 + i] for i in range(12)} == {classes[5]}
    for i in range(120, 128):
        assert classes[i] == i
    for i in (10, 163, 164, 165, 167, 168, 169, 170):
        assert classes[i] == i
    by = {r["doc_id"]: r for r in got}
    assert by[100]["n_links"] == 7 and by[101]["spans"][0]["start"] <= 20 and by[101]["spans"][-1]["end"] >= 80


def test_passages_of_many_texts(docs, texts, monkeypatch):
    monkeypatch.setattr(passages, "PAIRED", 2)
    classes = {r["doc_id"]: r["class_id"] for r in passages.near_passages(docs).collect()}
    assert {classes[100 + i] for i in range(8)} == {100} and classes[162] == 161


def fresh_words(rng, n: int) -> list[str]:
    return [f"v{k}" for k in rng.integers(10**9, size=n)]


def test_passages_of_many_texts_count_all_links(spark):
    rng = np.random.default_rng(7)
    one, two = fresh_words(rng, 25), fresh_words(rng, 25)
    both, passage = one + two, fresh_words(rng, 60)
    rows = [(i, " ".join(fresh_words(rng, 60) + passage + fresh_words(rng, 60))) for i in range(30)]
    for i in range(40):  # lines of many texts, which only two texts have one after the other
        rows.append((100 + i, " ".join(fresh_words(rng, 40) + (one if i % 2 else two) + fresh_words(rng, 40))))
    rows += [(200 + i, " ".join(fresh_words(rng, 40) + both + fresh_words(rng, 40))) for i in range(2)]
    # A line, then the whole passage that it is taken from.
    rows += [(300 + i, " ".join(fresh_words(rng, 60) + passage[:30] + fresh_words(rng, 60) + passage)) for i in range(2)]
    # Two passages with 30 other words between them; one passage at two places.
    first, second = fresh_words(rng, 55), fresh_words(rng, 55)
    rows += [(400 + i, " ".join(first + fresh_words(rng, 30) + second)) for i in range(2)]
    rows.append((402, " ".join(first + fresh_words(rng, 30) + first)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in passages.near_passages(frame).collect()}
    assert {got[i]["n_links"] for i in [*range(30), 300, 301]} == {31}
    assert {got[i]["class_id"] for i in [*range(30), 300, 301]} == {0}
    assert all(got[100 + i]["n_links"] == 0 for i in range(40))
    assert got[201]["class_id"] == 200 and got[200]["n_links"] == 1
    assert got[300]["spans"][-1]["start"] <= 150 and got[300]["spans"][-1]["end"] == 210
    for i in (400, 401):
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == [(0, 55), (85, 140)]
    assert [(s["start"], s["end"]) for s in got[402]["spans"]] == [(0, 55), (85, 140)]


def test_shared_ranges_are_all_of_a_stretch():
    x, y = np.arange(46, dtype=np.uint32), np.arange(100, 146, dtype=np.uint32)
    gap, other = np.arange(1000, 1034, dtype=np.uint32), np.arange(2000, 2034, dtype=np.uint32)
    got = passages.shared_ranges(np.concatenate([x, gap, y]), np.concatenate([x, other, y]))
    assert sorted(r[:4] for r in got) == [(0, 45, 0, 45), (80, 125, 80, 125)]
    got = passages.shared_ranges(x, np.concatenate([x, other, x]))
    assert {r[2:4] for r in got} >= {(0, 45), (80, 125)}


def test_stretches_that_can_share_nothing_are_not_cut(monkeypatch):
    """The quick refusal changes no result, and spares the cutting at gaps."""
    rng = np.random.default_rng(3)
    cases = []
    for i in range(300):
        x = rng.integers(400 if i % 3 else 60, size=rng.integers(46, 300)).astype(np.uint32)
        if i % 2:
            x = rng.permutation(400)[: len(x)].astype(np.uint32)
        y = np.where(rng.random(len(x)) < rng.choice([0, 0.02, 0.2, 0.9]), rng.integers(1000, 9000, len(x)), x).astype(np.uint32)
        cases.append((x, y if i % 5 else np.concatenate([y[60:], y[:60]])))
    quick = [passages.shared_ranges(x, y) for x, y in cases]
    with monkeypatch.context() as patch:
        patch.setattr(passages, "may_share", lambda x, y: True)
        assert [passages.shared_ranges(x, y) for x, y in cases] == quick
    assert 0 < sum(map(bool, quick)) < len(quick)
    monkeypatch.setattr(passages, "widest_gap", None)
    x = np.arange(200, dtype=np.uint32)
    assert passages.shared_ranges(x, np.where(x % 3 > 0, x, x + 1000)) == []


def test_pairs_of_a_group_need_a_text_in_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(passages, "TOGETHER", 100)
    rows = [(a, b, a, b, 0, 1) for a in range(60) for b in range(a + 1, 60)]
    got = passages.dealt(spark.createDataFrame(rows, passages.PASSAGES)).collect()
    assert sorted(tuple(r)[1:] for r in got) == rows
    needed = {(r["bucket"], r[side]) for r in got for side in "ab"}
    assert len(needed) <= 60 * 2 * 5 < len(rows)
    assert len({r["bucket"] for r in got}) > 5


def links_by_pair(texts: list[str], most: int) -> Counter:
    """Links of the windows of some texts, met in one bucket, by pair of texts."""
    windows = passages.windows_of([{"id": i, "text": t.encode()} for i, t in enumerate(texts)])
    jobs = passages.meet(256, most)(pa.table({"windows": [windows.tobytes()]}))
    found = Counter()
    for batch in passages.link_windows(4)(jobs.to_batches()):
        for row in batch.to_pylist():
            links = np.frombuffer(row["links"], dtype=passages.LINK)
            found.update(zip(links["a"].tolist(), links["b"].tolist(), strict=True))
    return found


def test_hot_lines_do_not_pair_their_texts_but_hot_passages_do():
    rng = np.random.default_rng(11)
    line, passage = fresh_words(rng, 13), fresh_words(rng, 60)
    texts = [fresh_words(rng, 60) + line + fresh_words(rng, 60) for _ in range(150)]
    # Every third word of half of the passages is another one in the first or last 15 words.
    for i in range(150):
        copy = list(passage)
        if i % 2:
            at = 0 if i % 4 == 1 else 45
            copy[at : at + 15 : 3] = fresh_words(rng, 5)
        texts.append(fresh_words(rng, 60) + copy + fresh_words(rng, 60))
    texts += [fresh_words(rng, 5) + line * 6 for _ in range(3)]
    texts = [" ".join(t) for t in texts]
    all_pairs, found = links_by_pair(texts, 10**6), links_by_pair(texts, 8)
    assert sum(a < 150 and b < 150 for a, b in all_pairs) > 10 * 150 >= sum(a < 150 and b < 150 for a, b in found)
    assert all((a, b) in found for a in range(150, 300, 2) for b in range(a + 2, 300, 2))
    # A window for several places meets all others of its key, a stretch of 30 shared shingles is met like before.
    assert {(300, 301), (300, 302), (301, 302)} <= set(found)
    assert {p for p in all_pairs if p[0] >= 150 and p[1] < 300} <= set(found)


def test_windows_of_hot_keys_are_all_paired(spark, monkeypatch):
    """Wherever windows of a hot key stand, they are paired; what wider pairs imply links no other texts."""
    rng = np.random.default_rng(17)
    line, passage = fresh_words(rng, 13), fresh_words(rng, 60)
    texts = [" ".join(fresh_words(rng, 60) + line + fresh_words(rng, 60)) for _ in range(40)]
    for i in range(20):
        copy = passage[:25] + fresh_words(rng, i % 2) + passage[25 + i % 2 :]
        texts.append(" ".join(fresh_words(rng, 30) + copy + fresh_words(rng, 30)))
    texts += [" ".join(fresh_words(rng, 5) + line * 6) for _ in range(3)]
    all_pairs, meet = set(links_by_pair(texts, 10**6)), passages.meet
    with monkeypatch.context() as patch:
        patch.setattr(passages, "meet", lambda block, most: meet(block, most, whole=True))
        assert set(links_by_pair(texts, 8)) == all_pairs
    frame, found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    plain = passages.stored
    for hot in (8, 10**6):
        kept = {}
        monkeypatch.setattr(passages, "HOT", hot)
        monkeypatch.setattr(passages, "stored", lambda df, purpose, *path, kept=kept: kept.setdefault(purpose, plain(df, purpose, *path)))
        got = sorted(map(repr, passages.near_passages(frame).collect()))
        found.append((got, kept["jobs"].agg(F.sum("pairs")).first()[0]))
    assert found[0] == found[1]


def test_turns_change_nothing_and_write_over_each_other(docs, monkeypatch):
    plain, kept = passages.stored, []

    def stored(df, purpose, path=None):
        kept.append((purpose, path, plain(df, purpose, path)))
        return kept[-1][2]

    monkeypatch.setattr(passages, "stored", stored)
    monkeypatch.setattr(passages, "TURN_SHARE", 0)
    found = []
    for turns in (1, 3):
        kept.clear()
        found.append(sorted(map(repr, passages.near_passages(docs).collect())))
        assert len([purpose for purpose, *_ in kept if purpose == "verified"]) == turns
        assert all(len({path for made, path, _ in kept if made == name} - {None}) == 1 for name in ("passages", "dealt"))
        pairs = next(frame for purpose, _, frame in kept if purpose == "jobs").agg(F.sum("pairs")).first()[0]
        monkeypatch.setattr(passages, "TURN_BYTES", -(-pairs * passages.LINK.itemsize // 3))
    assert found[0] == found[1]


def shuffle_files(spark) -> int:
    made = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    n = 0
    while made.hasNext():
        n += made.next().getName().startswith("shuffle_")
    return n


def test_stored_frames_leave_no_shuffles(spark):
    spark.sparkContext._jvm.System.gc()
    before = shuffle_files(spark)
    got = passages.stored(spark.range(1000).repartition(7).groupBy(F.col("id") % 10).count(), "kept")
    assert got.count() == 10
    left = [shuffle_files(spark) - before, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")]
    # The count has a shuffle of one row per task.
    assert left[0] <= 2 * spark.sparkContext.defaultParallelism and left[1] == "false"


def test_sums_of_a_bucket_are_those_of_its_pairs():
    rng = np.random.default_rng(23)
    base, cuts, pairs = rng.integers(10**6, size=120), [], []
    for i in range(6):
        text = np.concatenate([base[60 * (i % 2) :], rng.integers(10**6, 10**9, 30)]) if i < 5 else rng.integers(10**6, 10**9, 90)
        cuts.append((0, i, 0, text.astype(np.uint32).tobytes()))
    lengths = [len(c[3]) // 4 - 1 for c in cuts]
    pairs += [(a, b, 0, lengths[a], 0, lengths[b]) for a in range(6) for b in range(a + 1, 6)]
    table = pa.table({n: pa.array([p[i] for p in pairs], type=pa.int64()) for i, n in enumerate(passages.STRETCH)})
    cut = pa.table({n: [c[i] for c in cuts] for i, n in enumerate(("bucket", "id", "start", "hashes"))})
    found = passages.verify(table, cut).to_pylist()
    want = {}
    for r in found:
        for x, y in ("ab", "ba"):
            others, spans = want.setdefault(r[x], (set(), []))
            others.add(r[y])
            spans.append((r[f"{x}_from"], r[f"{x}_to"]))
    got = {r["id"]: r for r in passages.verified_sums(table, cut).to_pylist()}
    assert set(got) == set(want) == set(range(5)) and {r["top"] for r in got.values()} == {0}
    for i, (others, spans) in want.items():
        assert got[i]["n_links"] == len(others) == 4
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == decontaminate.merged(spans)


def test_stretches_left_out_at_once_share_nothing(monkeypatch):
    """No similar part is lost, and places are left out that no long stretch makes up for."""
    rng = np.random.default_rng(29)
    lines, cuts, pairs = [rng.integers(10**6, size=9) for _ in range(4)], [], []
    for i in range(30):
        base = np.random.default_rng(i % 3).integers(10**6, 2 * 10**6, 90)
        text = np.where(rng.random(90) < 0.04 * (i % 5), rng.integers(10**8, 10**9, 90), base)
        fresh = [rng.integers(10**8, 10**9, 70) for _ in range(2)]
        text = np.concatenate([fresh[0], lines[i % 4], *([text] if i < 24 else [text[:5]] * 20), lines[i % 4], fresh[1][i % 2 * 70 :]])
        cuts.append((0, i, 0, text.astype(np.uint32).tobytes()))
    lengths = [len(c[3]) // 4 for c in cuts]
    for a in range(30):
        for b in range(a + 1, 30):
            pairs += [(a, b, 0, lengths[a] - 1, 0, lengths[b] - 1), (a, b, 20, 100, 20, 100)]
    table = pa.table({n: pa.array([p[i] for p in pairs], type=pa.int64()) for i, n in enumerate(passages.STRETCH)})
    cut = pa.table({n: [c[i] for c in cuts] for i, n in enumerate(("bucket", "id", "start", "hashes"))})
    got = passages.verify(table, cut).to_pylist()
    numbers, text = np.concatenate([np.frombuffer(c[3], dtype=np.uint32) for c in cuts]).astype(np.int64), np.repeat(range(30), lengths)
    numbers = np.unique(numbers, return_inverse=True)[1]
    held = passages.in_dense(numbers, text)
    holders = {}
    for n, t in zip(numbers.tolist(), text.tolist(), strict=True):
        holders.setdefault(n, []).append(t)
    worth = [20 if len(set(holders[n])) > 1 else 0 if len(holders[n]) > 1 else -80 for n in numbers.tolist()]
    want, at = np.zeros(len(held), dtype=bool), 0
    for n in lengths:
        sums = np.append(0, np.cumsum(worth[at : at + n]))
        for low in range(n):
            ends = np.flatnonzero(sums[low + 46 :] >= sums[low])
            if len(ends):
                want[at + low : at + low + 46 + int(ends[-1])] = True
        at += n
    assert (held == want).all() and 0.1 < held.mean() < 0.9
    monkeypatch.setattr(passages, "in_dense", lambda numbers, text: np.ones(len(numbers), dtype=bool))
    calls, plain = [], passages.similar_parts
    monkeypatch.setattr(passages, "similar_parts", lambda x, y, one: calls.append(1) or plain(x, y, one=one))
    assert passages.verify(table, cut).to_pylist() == got and got
    every = len(calls)
    monkeypatch.undo()
    monkeypatch.setattr(passages, "similar_parts", lambda x, y, one: calls.append(1) or plain(x, y, one=one))
    passages.verify(table, cut)
    assert len(calls) - every < every


def test_known_passages_are_not_verified_again():
    """Links and words of passages are those of all stretches, with fewer of them looked through."""
    rng = np.random.default_rng(13)
    base, pairs, cuts = rng.integers(10**6, size=300), [], []
    for i in range(24):
        text = np.where(rng.random(300) < 0.015, rng.integers(10**6, 10**9, 300), base).astype(np.uint32)
        cuts.append((0, i, 0, np.concatenate([text, rng.integers(10**9, 2 * 10**9, 40)]).astype(np.uint32).tobytes()))
    for a in range(24):
        for b in range(a + 1, 24):
            pairs += [(a, b, low, low + n, low, low + n) for low, n in ((0, 300), (0, 339), (int(rng.integers(200)), 80))]
    names = ("a", "b", "a_from", "a_to", "b_from", "b_to")
    table = pa.table({n: pa.array([p[i] for p in pairs], type=pa.int64()) for i, n in enumerate(names)})
    cut = {n: [c[i] for c in cuts] for i, n in enumerate(("bucket", "id", "start", "hashes"))}
    got = passages.verify(table, pa.table(cut)).to_pylist()
    texts = [np.frombuffer(c[3], dtype=np.uint32) for c in cuts]
    plain = []
    for a, b, a_from, a_to, b_from, b_to in pairs:
        for low, high, other_low, other_high, _ in passages.shared_ranges(texts[a][a_from : a_to + 1], texts[b][b_from : b_to + 1]):
            plain += [(a, b, a_from + low, a_from + high + 5), (b, a, b_from + other_low, b_from + other_high + 5)]
    seen = [(r["a"], r["b"], r["a_from"], r["a_to"]) for r in got] + [(r["b"], r["a"], r["b_from"], r["b_to"]) for r in got]

    def words(rows):
        return {t: decontaminate.merged([r[2:] for r in rows if r[0] == t]) for t in range(24)}

    assert {r[:2] for r in seen} == {r[:2] for r in plain} and words(seen) == words(plain)
    assert 2 * len(got) < 0.7 * len(plain)


def plain_limits(hashes, place):
    low, high = place, place
    while low > 0 and hashes[low - 1] >= hashes[place]:
        low -= 1
    while high < len(hashes) - 1 and hashes[high + 1] >= hashes[place]:
        high += 1
    return low, high


@pytest.mark.parametrize("kind", ["any", "ties", "rising", "ends", "deep"])
def test_limits_of_compact_windows_have_no_reach(kind):
    rng = np.random.default_rng(5)
    hashes = rng.integers(1, 5 if kind == "ties" else 1 << 60, 30_000, dtype=np.uint64)
    if kind == "rising":
        hashes.sort()
    elif kind == "ends":
        hashes[rng.integers(0, len(hashes), 40)] = 0
    elif kind == "deep":
        hashes[[15_000, 40, 29_990]] = 1
    made = list(zip(*(x.tolist() for x in passages.compact_windows(hashes)), strict=True))
    assert made and max(b - a for _, a, b in made) > (8191 if kind != "ends" else 127)
    for place, left, right in made[:: max(1, len(made) // 60)] + sorted(made, key=lambda w: w[1] - w[2])[:5]:
        assert (left, right) == plain_limits(hashes.tolist(), place)


def test_compact_windows_are_all_and_only():
    rng = np.random.default_rng(3)
    values = rng.integers(1, 60, size=400).astype(np.uint64)
    values[[0, 150, 151, 300]] = 0
    found = set(zip(*(x.tolist() for x in passages.compact_windows(values)), strict=True))
    want = set()
    for c in range(len(values)):
        left = right = c
        while values[c] and left > 0 and values[left - 1] >= values[c]:
            left -= 1
        while values[c] and right + 1 < len(values) and values[right + 1] >= values[c]:
            right += 1
        if values[c] and right - left + 1 >= passages.LEAST:
            want.add((c, left, right))
    assert found == want


@pytest.mark.parametrize("shards", [16, 3])
def test_shards(docs, texts, shards):
    got = sharding.shard_documents(docs, shards=shards).collect()
    assert len(got) == len(texts)
    slots, places = defaultdict(list), defaultdict(set)
    sums = {(i, zlib.crc32((t or "").encode())): len((t or "").encode()) + 1 for i, t, *_ in texts}
    for r in got:
        assert r["size"] == sums[(r["doc_id"], r["text_crc32"])] and r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        places[r["text_crc32"]].add(r["shard"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    group = zlib.crc32(texts[5][1].encode())
    assert len(places[group]) == -(-13 // (len(texts) // shards))  # only the group above the quota is split


def test_nearest(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 16)).round(3)
    rows = [(i, base[i % 280].tolist()) for i in range(300)]
    rows += [(400 + i, base[50].tolist()) for i in range(30)] + [(450, (2 * base[50]).tolist())]
    rows += [(500, None), (550, [0.0] * 16), (600, [float("nan")] * 16), (650, [None] * 16), (700, []), (None, rows[0][1])]
    rows += [(750, [float("inf")] + [1.0] * 15), (800, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.nearest(frame.withColumn("rank", F.lit(1)), F.col("vec_id") % 50 == 0, block=64, chunk=4).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and i not in (500, 550, 600, 650, 700, 750, 800)]
    ids = np.array([i for i, _ in good])
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 50 == 0]
    assert set(found) == set(asked)
    hits = 0
    for q in asked:
        scores = (unit @ unit[list(ids).index(q)]).round(12)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:5]
        assert len(found[q]) == 5 and all(s == pytest.approx(scores[list(ids).index(v)]) for v, s in found[q])
        hits += len({int(ids[k]) for k in order} & {v for v, _ in found[q]})
    assert hits >= 0.9 * 5 * len(asked)
    assert [v for v, _ in found[400]] == [50, 401, 402, 403, 404]  # ties by id


def brute_lines(texts, least):
    seen, out = set(), {}
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0))
    for i in order:
        text = texts[i][1]
        parts = [] if text is None else text.split("\n")
        gone = set()
        for j in range(len(parts) - least + 1):
            run = tuple(parts[j : j + least])
            if run in seen:
                gone |= set(range(j, j + least))
            seen.add(run)
        kept = "\n".join(p for j, p in enumerate(parts) if j not in gone)
        runs = sum(j - 1 not in gone for j in gone)
        out[i] = (texts[i][0], len(parts), len(gone), runs, hashlib.sha256(kept.encode()).hexdigest())
    return Counter(out.values())


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines(docs, texts, least):
    got = lines.dedup_lines(docs, min_lines=least)
    assert rows_of(got.select("doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256")) == brute_lines(texts, least)


def test_licenses(docs, texts):
    got = licenses.license_summary(licenses.scan_licenses(docs)).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    r = by[166]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (11, 3, 1, 8)
    assert r["base_labels"] == "cc-by-nc,mit" and r["score"] == 1.0
    assert by[167]["n_words"] == 0 and by[167]["first_word"] is None and by[167]["labels"] == ""


def test_fuzzy_notices():
    scanner = licenses.Scanner([licenses.notice(p, x, True, 10) for p, x in licenses.BASE])
    def found(text):
        return [(s["label"], s["base"], s["first_word"], s["errors"]) for s in licenses.scan_text(scanner, text.encode())[1]]
    assert found("a Under the MIT license!") == [("mit", True, 1, 0)]
    assert found("relesed undr the mit licence here") == [("mit", False, 1, 2)]
    assert found("under the mat lizense of anothr kinds") == [("mit", False, 0, 2)]
    assert found("under the wide sky, a lizard") == []
    assert found("Apache License, Version 2.0") == [("apache-2", True, 0, 0)]
    assert found("cc by nc cc by nc") == [("cc-by-nc", True, 0, 0), ("cc-by-nc", True, 3, 0)]
    assert found("xcc by nc") == [] or not found("xcc by nc")[0][1]


def brute_ends(text, phrase, errors):
    """Ends and latest starts of the stretches of a text with so many errors at most, by edit distances."""
    cells = [(j, 0) for j in range(len(phrase) + 1)]  # distance, start
    found = []
    for i, c in enumerate(text):
        row = [(0, i + 1)]
        for j, p in enumerate(phrase):
            steps = (cells[j][0] + (p != c), cells[j][1]), (cells[j + 1][0] + 1, cells[j + 1][1]), (row[j][0] + 1, row[j][1])
            row.append(min(steps, key=lambda x: (x[0], -x[1])))
        cells = row
        if row[-1][0] <= errors:
            found.append((row[-1][1], i + 1))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_notices_against_edit_distances(seed):
    """Every stretch within the errors overlaps a reported one, and every reported one is within them."""
    rng = random.Random(seed)
    notices = [licenses.notice(p, x, True, 10) for p, x in licenses.BASE + licenses.MORE[:4]]

    def edited(phrase):
        out = list(phrase)
        for _ in range(rng.randint(0, len(phrase) // 10 + 1)):
            at = rng.randrange(len(out))
            out[at : at + 1] = rng.choice([[], [out[at], rng.choice("abe ")], [rng.choice("ixz")]])
        return "".join(out)

    parts = [edited(rng.choice(notices[:7]).phrase) if rng.random() < 0.6 else "".join(rng.choices("aceilnrstu ", k=rng.randint(0, 15))) for _ in range(40)]
    text = f" {' '.join(alnum(' '.join(parts)))} "
    spans = licenses.Scanner(notices).spans(text)
    assert len(spans) > 5
    for n in notices:
        mine = [(a, b) for a, b, errors, m in spans if m is n]
        near = brute_ends(text, n.phrase, n.errors)
        missed = [(a, b) for a, b in near if n.errors and not any(a < y and x < b for x, y in mine)]
        assert missed == []
        assert all(brute_ends(text[a:b], n.phrase, n.errors) for a, b in mine)
        places = {i for i in range(len(text)) if text.startswith(f" {n.phrase} ", i)}
        assert {a - 1 for a, b, errors, m in spans if m is n and errors == 0 and text[a - 1] == text[b] == " "} >= places


def brute_bytes(texts):
    seen, out = set(), {}
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0))
    for i in order:
        data = (texts[i][1] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        spans = sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (texts[i][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return Counter(out.values())


@pytest.mark.parametrize("wide", [8192, 1])
def test_substrings(docs, texts, wide, monkeypatch):
    monkeypatch.setattr(substrings, "WIDE", wide)
    got = substrings.dedup_substrings(docs)
    made = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    # Texts without an id share no order but the hash, so only their sums are fixed.
    assert rows_of(made.where("doc_id IS NOT NULL")) == Counter(
        {k: v for k, v in brute_bytes(texts).items() if k[0] is not None}
    )


def test_suffix_sort_is_lexicographic():
    rng = np.random.default_rng(5)
    piece = rng.integers(97, 99, size=300).astype(np.uint8)
    data = np.concatenate([piece, piece[20:250], rng.integers(97, 99, size=200).astype(np.uint8), piece])
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    room = len(data) - np.arange(len(data))
    suffixes = np.flatnonzero(room >= 100)
    words = substrings.eights(padded)[: len(data)]
    order, classes = substrings.sort_suffixes(words, substrings.cover_ranks(words, room), suffixes)
    windows = [bytes(data[i : i + 100]) for i in order]
    assert windows == sorted(windows) and sorted(order.tolist()) == suffixes.tolist()
    assert [a == b for a, b in zip(windows, windows[1:])] == (np.diff(classes) == 0).tolist()


def brute_fingerprint(text):
    ws = [w.encode() for w in spaced(text)]
    shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and 2 * ones[b] > len(shingles))


@pytest.mark.parametrize("paired", [64, 1])
def test_simhash(spark, docs, texts, paired, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    made = simhash.with_fingerprints(docs)
    by_text = {(r["doc_id"], r["fp"] & (2**64 - 1)) for r in made.collect()}
    assert by_text == {(i, brute_fingerprint(t)) for i, t, *_ in texts}
    rng = np.random.default_rng(6)
    centre = int(rng.integers(1 << 62))
    fps = [centre] + [centre ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for k in (1, 2, 3, 4, 5, 6) * 12]
    fps += [int(x) for x in rng.integers(1 << 62, size=40)]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long").union(made)
    got = simhash.with_components(frame).collect()
    nodes = {}
    for r in frame.collect():
        nodes.setdefault(r["fp"], []).append(r["doc_id"])
    label = {f: f for f in nodes}
    changed = True
    while changed:
        changed = False
        for f in nodes:
            best = min(label[g] for g in nodes if bin((f ^ g) & (2**64 - 1)).count("1") <= 3)
            if best < label[f]:
                label[f], changed = best, True
    least = defaultdict(list)
    for f, ids in nodes.items():
        least[label[f]] += [i for i in ids if i is not None]
    assert len(got) == frame.count()
    for r in got:
        assert r["component_id"] == min(least[label[r["fp"]]], default=None)


def test_one_of_each(docs, texts):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(170) == 1 and 171 not in ids and 140 not in ids and 5 in ids
    assert len([i for i in (165, 167, 168, 169) if i in ids]) == 1  # texts without words


@pytest.mark.parametrize("paired", [1, 64])
def test_one_of_each_is_one_of_each_component(spark, docs, texts, paired, monkeypatch):
    """Near copies of one text, in a group that is wider than the pairs that are compared at once."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(1000 + i, t) for i, t, *_ in texts if i is not None] + [(900, " ".join(base))]
    for i in range(100):
        copy = list(base)
        copy[int(rng.integers(400))] = f"v{i % 50}"
        rows.append((i, " ".join(copy)))
    prints = {f: brute_fingerprint(t) for f, t in rows}
    top = {f: f for f in prints.values()}
    changed = True
    while changed:
        changed = False
        for f in top:
            best = min(top[g] for g in top if (f ^ g).bit_count() <= 3)
            changed |= best < top[f]
            top[f] = min(top[f], best)
    want = {}
    for i, _ in rows:
        want[top[prints[i]]] = min(i, want.get(top[prints[i]], i))
    assert sum(i < 100 for i, _ in rows) - sum(i < 100 for i in want.values()) > 50
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want.values())


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.quality_scores(quality.with_statistics(docs), labels).join(labels, "doc_id").collect()
    held = [r for r in scored if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_quality_on_odd_rows(spark, docs, texts):
    teach = [(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (5, 0, 0), (5, 0, 0), (999, 1, 0)]
    labels = spark.createDataFrame(teach, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(quality.with_statistics(docs), labels).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.accepted(docs, labels)
    assert kept.schema == docs.schema
    none = quality.quality_scores(quality.with_statistics(docs), labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_empty_tables(spark, nothing, benchmark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    frames = [
        mixing.mix(nothing),
        decontaminate.decontaminate(nothing, benchmark),
        decontaminate.benchmark_hits(nothing, benchmark.where("false"), {"doc_id": "doc_id"}),
        passages.near_passages(nothing),
        sharding.shard_documents(nothing),
        forest.nearest(vectors, F.col("vec_id") % 50 == 0),
        lines.dedup_lines(nothing),
        licenses.license_summary(licenses.scan_licenses(nothing)),
        substrings.dedup_substrings(nothing),
        simhash.with_components(simhash.with_fingerprints(nothing)),
        simhash.one_of_each(nothing),
        quality.quality_scores(quality.with_statistics(nothing), labels),
        quality.accepted(nothing, labels),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def plain_statistics(text):
    """The statistics of a text once more, letter by letter."""
    data, found = (text or "").encode(), (text or "").encode().split()
    ascii_ = [chr(b) for b in data if b < 128]

    def angle(part, whole):
        return np.arcsin(np.sqrt(min(part / whole, 1))) if whole else 0.0

    def share(test):
        return angle(sum(map(test, ascii_)), len(data))

    n, parts = len(found), data.split(b"\n")
    plain_marks = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in ".,;:'\"-?()|"]
    return [
        np.log(1 + n),
        np.log(1 + (len(data) - n) / n) if n else 0.0,
        angle(sum(c.isupper() for c in ascii_), sum(c.isalpha() for c in ascii_)),
        share(str.isdigit),
        share(lambda c: c in ".,;:'\"-?()"),
        share(lambda c: c in plain_marks),
        share(lambda c: c == "|"),
        angle(sum(found[i] == found[i - 1] for i in range(1, n)), n),
        angle(max(Counter(found).values()) if n else 0, n),
        np.log((len(set(found)) + 0.5) / (n + 0.5)),
        np.log(1 + n / len(parts)),
        angle(sum(parts[i] == parts[i - 1] for i in range(1, len(parts))), len(parts)),
    ]


def test_quality_against_densities(spark, docs, texts):
    """Scores from normal densities of the plain statistics, without Cholesky factors."""
    labels = {i: int(i % 3 > 0) for i in range(130)}
    x = {i: np.array(plain_statistics(t)) for i, t, *_ in texts if i is not None}
    x_of_null = [np.array(plain_statistics(t)) for i, t, *_ in texts if i is None]
    teachers = [i for i, *_ in texts if i in labels and zlib.crc32(str(i).encode()) % 5]
    groups = [np.array([x[i] for i in teachers if labels[i] == c]) for c in (0, 1)]
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * np.diag(c) for g, c in zip(groups, own)) / len(teachers)
    shrunk = [0.95 * c + 0.05 * np.diag(np.maximum(pooled, 1e-6)) for c in own]

    def density(v, c):
        d = v - groups[c].mean(axis=0)
        return -0.5 * (d @ np.linalg.solve(shrunk[c], d) + np.linalg.slogdet(shrunk[c])[1])

    def plain_score(v):
        odds = density(v, 1) - density(v, 0) + np.log((len(groups[1]) + 1) / (len(groups[0]) + 1))
        return 1 / (1 + np.exp(-np.arcsinh(odds)))

    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = quality.quality_scores(quality.with_statistics(docs), table).collect()
    made = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in got))
    want = sorted([(False, i, plain_score(x[i])) for i, *_ in texts if i is not None] + [(True, 0, plain_score(v)) for v in x_of_null])
    assert [m[:2] for m in made] == [w[:2] for w in want]
    assert np.allclose([m[2] for m in made], [w[2] for w in want], atol=1e-6)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
