"""Registration of queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarnwheel.session import apply_defaults, partitions_of_folder, start_partitions
from tarnwheel.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        start_partitions(apply_defaults(spark), partitions_of_folder(spark, folder))
        return self.build(Tables(spark, folder))


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Query(name, fn, " ".join(sql.split()) if sql else None)
        return fn

    return register


# Fragments of the SQL twins.  They state the same exact arithmetic as
# ``tarnwheel.functions``.


def sql_money(c: str) -> str:
    return f"CAST({c} AS DECIMAL(18,2))"


SQL_REVENUE = "(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))"


def sql_sum(expression: str, places: int = 2) -> str:
    return f"CAST(round(sum({expression}), {places}) AS DOUBLE)"


def sql_round(expression: str, places: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,9)), {places}) AS DOUBLE)"


def sql_mean(expression: str, places: int) -> str:
    return sql_round(f"(CAST(sum({expression}) AS DOUBLE) / nullif(count({expression}), 0))", places)


def sql_date(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def sql_month(c: str) -> str:
    return f"strftime({c}, '%Y-%m')"
