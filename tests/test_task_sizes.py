"""What one task reads is bounded, whatever number of shuffle partitions a session names."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest

import __spark_entry__ as entry
from support import DATA as TABLES
from tarnwheel import session
from tarnwheel.plans import streams
from tarnwheel.streaming import state


DATA = str(TABLES / "sf0.001")


@pytest.fixture
def two_partitions(spark):
    """A session of its own with two shuffle partitions."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def shuffled(frame) -> list[int]:
    """Partitions of all shuffles of a plan that has run."""
    frame.collect()
    return [int(p.split(")")[0].split(", ")[-1]) for p in plan(frame).split("hashpartitioning(")[1:]]


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pip11_supplier_pairs_sharing_orders", "v04_row_differences"])
def test_shuffles_start_from_more_partitions_for_larger_tables(two_partitions, monkeypatch, name):
    before = entry.queries()[name](two_partitions, DATA)
    assert set(shuffled(before)) == {2}
    monkeypatch.setattr(session, "INITIAL_PARTITION_BYTES", session.stored_bytes(two_partitions, DATA) // 64)
    session.partitions_of_folder.cache_clear()
    after = entry.queries()[name](two_partitions, DATA)
    assert min(shuffled(after)) >= 64
    session.partitions_of_folder.cache_clear()
    assert sorted(after.collect(), key=repr) == sorted(before.collect(), key=repr)


def test_stored_bytes_counts_files(spark, tmp_path):
    for file in Path(DATA).glob("n*.parquet"):
        shutil.copy(file, tmp_path)
    assert session.stored_bytes(spark, str(tmp_path)) == sum(f.stat().st_size for f in tmp_path.glob("*.parquet")) > 0


def test_records_of_a_state_are_written_by_the_tasks_that_make_them(spark, tmp_path, monkeypatch):
    """Two files per task instead of four in all, two batches, and each record once."""
    monkeypatch.setattr(streams, "scratch_path", lambda *_: str(tmp_path))
    data = '{"submission_id": %d, "seq": %d, "question_id": "Q%d"}'
    rows = [(f"event: question_result\ndata: {data % (i % 7, i, i)}",) for i in range(700)]
    answers, submissions = streams._kept_state(spark.createDataFrame(rows, "value string").repartition(8), spark)
    assert len(list(tmp_path.glob("in/*/part-*"))) == 16
    assert len(list(tmp_path.glob("state/manifest/batch=*"))) == 2
    assert answers.count() == 700 and submissions.count() == 7
    assert len(spark.read.text(f"{tmp_path}/in/*", lineSep="\n\n").collect()) == 700


def test_a_batch_starts_from_partitions_for_its_splits(spark, tmp_path, monkeypatch):
    started = []
    monkeypatch.setattr(state, "start_partitions", lambda _, least: started.append(least))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for splits in (2, 6):
        rows = [(f'event: done\ndata: {{"submission_id": {i}, "seq": {i}}}',) for i in range(12)]
        state.absorb(spark.createDataFrame(rows, "value string").repartition(splits), 0, f"{tmp_path}/{splits}", 100)
    assert started[0] == 2 * state.PER_SPLIT and started[2] == 6 * state.PER_SPLIT
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
