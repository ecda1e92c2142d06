"""Schemas and keys of the result store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHAPE = "STRUCT<rows: BIGINT, cols: BIGINT>"

# Columns, types and nullability of the five tables.
_COLUMNS = {
    "user": "id STRING NOT NULL, name STRING NOT NULL, email STRING NOT NULL, image STRING",
    "team": """id STRING NOT NULL, name STRING NOT NULL, slug STRING NOT NULL, description STRING, vm_url STRING,
        owner_id STRING NOT NULL, created_at TIMESTAMP NOT NULL""",
    "team_member": """team_id STRING NOT NULL, user_id STRING NOT NULL, role STRING NOT NULL,
        joined_at TIMESTAMP NOT NULL""",
    "submission": """id STRING NOT NULL, team_id STRING NOT NULL, submitted_by_user_id STRING NOT NULL,
        repo_url STRING NOT NULL, kind STRING NOT NULL, benchmark_name STRING, status STRING NOT NULL,
        total_questions BIGINT NOT NULL, completed_questions BIGINT NOT NULL, exact_match_count BIGINT NOT NULL,
        avg_generation_seconds DOUBLE, avg_execution_seconds DOUBLE, peak_ram_mb DOUBLE, peak_gpu_mb DOUBLE,
        composite_score DOUBLE, accuracy DOUBLE, final_score DOUBLE, error_message STRING,
        created_at TIMESTAMP NOT NULL, started_at TIMESTAMP, finished_at TIMESTAMP""",
    "benchmark_result": f"""id STRING NOT NULL, submission_id STRING NOT NULL, question_id STRING NOT NULL,
        question_text STRING NOT NULL, generated_code STRING, stdout STRING, stderr STRING, success BOOLEAN,
        exact_match BOOLEAN, generation_duration_seconds DOUBLE, execution_duration_seconds DOUBLE,
        peak_ram_mb DOUBLE, peak_gpu_mb DOUBLE, generated_hash STRING, gold_hash STRING, generated_shape {SHAPE},
        gold_shape {SHAPE}, generated_columns ARRAY<STRING>, gold_columns ARRAY<STRING>,
        created_at TIMESTAMP NOT NULL""",
}
# The unique keys of each table, the primary one first.
KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "user": (("id",), ("email",)),
    "team": (("id",), ("name",), ("slug",)),
    "team_member": (("team_id", "user_id"), ("user_id",)),
    "submission": (("id",),),
    "benchmark_result": (("id",), ("submission_id", "question_id")),
}
# What a row has where nothing is given.
DEFAULTS = {
    "submission": {"status": "queued", "total_questions": 0, "completed_questions": 0, "exact_match_count": 0},
    "team_member": {"role": "member"},
}


def store_schema(name: str) -> T.StructType:
    """The schema of a table of the store."""
    return T.StructType.fromDDL(_COLUMNS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a store table in their order and types; other columns go.

    A column that is not there gets its default, or null if it may be null.
    """
    given, columns = set(df.columns), []
    for field in store_schema(name):
        default = DEFAULTS.get(name, {}).get(field.name)
        if field.name in given:
            value = F.col(field.name)
        elif default is not None or field.nullable:
            value = F.lit(default)
        else:
            raise ValueError(f"{name}.{field.name} is required")
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def key_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table and unique key: key values on several rows, the rows too many, and rows without a required value.

    One pass per table: all its keys are grouping sets of one aggregate.  A table
    without rows has zeros; other columns are not read.
    """
    out = None
    for name, df in tables.items():
        keys = KEYS[name]
        columns = sorted({c for key in keys for c in key})
        missing = F.lit(False)
        for field in store_schema(name):
            missing = missing | F.col(field.name).isNull() if not field.nullable else missing
        per_value = df.groupingSets([[F.col(c) for c in key] for key in keys], *columns).agg(
            F.grouping_id().alias("__set"),
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(missing, F.lit(1))).alias("incomplete"),
        )
        # The number of a set has a bit for each column that is not in it, the first column highest.
        found = []
        for key in keys:
            number = int("".join("0" if c in key else "1" for c in columns), 2)
            of_key = F.col("__set") == number
            found.append(
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(",".join(key)).alias("key_columns"),
                    F.count(F.when(of_key & (F.col("n") > 1), F.lit(1))).alias("repeated_keys"),
                    F.coalesce(F.sum(F.when(of_key, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
                    F.coalesce(F.sum(F.when(of_key, F.col("incomplete"))), F.lit(0)).alias("incomplete_rows"),
                )
            )
        one = per_value.agg(F.array(*found).alias("found")).select(F.inline("found"))
        out = one if out is None else out.unionByName(one)
    return out
