"""The registered queries against their SQL twins, and the stages of the pipeline."""

from __future__ import annotations

from collections import Counter

import pytest
from brute import alnum, spaced

import __spark_entry__ as entry
import corpus_pipeline
from support import DATA, check
from tarnwheel.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_twins(spark, name):
    ((_, _, problem, rows),) = check(spark, DATA / "sf0.001", [name])
    assert problem is None and rows == 200


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13 + 1))


@pytest.fixture(scope="module")
def folder(spark, docs, benchmark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(f"{out}/documents.parquet")
    benchmark.write.parquet(f"{out}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(163, 0, 0), (164, 0, 0), (165, 0, 0), (None, 0, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_on_odd_rows(spark, docs, folder):
    stages = dict(corpus_pipeline.STAGES)
    made = {"": docs}
    for name, stage in stages.items():
        before = list(made.values())[-1]
        made[name] = stage(spark, before, folder).cache()
        if name != "sharding":
            assert made[name].columns == docs.columns, name
    texts = {n: Counter(r["text"] for r in d.select("text").collect()) for n, d in made.items() if n != "sharding"}
    assert texts["quality"] <= texts[""]
    kept = texts["near_duplicates"]
    assert kept <= texts["quality"] and max(kept.values()) == 1
    assert set(texts["mixing"]) <= set(texts["decontamination"]) and max(texts["mixing"].values()) <= 3
    items = [alnum(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    for text in texts["decontamination"]:
        words = alnum(text)
        assert not any(tuple(words[i : i + 10]) in windows for i in range(len(words) - 9)) or len(words) > 1000
    counts = Counter(r["shard"] for r in made["sharding"].collect())
    assert sum(counts.values()) == made["mixing"].count() and max(counts.values()) - min(counts.values()) <= 1


def test_stages_on_empty_tables(spark, nothing, benchmark, tmp_path):
    benchmark.where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_run(spark):
    folder = str(DATA / "sf0.001")
    rows = corpus_pipeline.run(spark, folder).collect()
    sizes = {r["doc_id"]: len(spaced(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows and {r["doc_id"] for r in rows} <= set(sizes)
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
