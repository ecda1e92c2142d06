"""The 105 questions on generated corpus tables, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from support import difference
from tarnwheel.plans import corpus
from tarnwheel.sources.synthetic import TABLES, generate, generate_all
from tarnwheel.sources.tables import open_registry

MACROS = (
    "CREATE MACRO whole_days(later, earlier) AS date_sub('day', CAST(earlier AS TIMESTAMP), CAST(later AS TIMESTAMP))",
    "CREATE MACRO day_gap(later, earlier) AS date_diff('day', CAST(earlier AS DATE), CAST(later AS DATE))",
)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    generate_all(spark, str(folder), scale=0.05)
    open_registry(spark, {n: {"file_name": f"{n}.parquet"} for n in TABLES}, root=str(folder))
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    for macro in MACROS:
        connection.execute(macro)
    return connection


def test_there_are_105_questions():
    assert len(corpus.questions()) == 105
    assert len(TABLES) == 59


@pytest.mark.parametrize("name", corpus.questions())
def test_question(spark, tables, name):
    twin = corpus.FRAMES[name][1] if name in corpus.FRAMES else corpus.SQL[name]
    assert difference(corpus.run(spark, name).toPandas(), tables.execute(twin).df()) is None


def test_generator_does_not_depend_on_partitions(spark):
    a = generate(spark, "nw_order_details", 0.01)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        b = generate(spark, "nw_order_details", 0.01)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


@pytest.mark.parametrize(
    ("name", "keys"),
    [("nw_order_details", ["order_id", "product_id"]), ("sk_film_actor", ["film_id", "actor_id"]), ("tpch_partsupp", ["ps_partkey", "ps_suppkey"])],
)
def test_children_are_distinct(spark, name, keys):
    df = generate(spark, name, 0.2)
    assert df.count() == df.select(*keys).distinct().count()
