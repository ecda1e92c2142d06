from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

#: Names that the operators use themselves.
CLASHING = ("key", "bucket", "size", "score", "shard", "fp", "row_number", "copies", "spans", "features", "__text")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in CLASHING),
    ]
)
SYLLABLES = "ba co di fu ge ha li mo nu pe ra si to vu we é ß".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Rows ``doc_id, text, lang, source``: nulls, empty, long and periodic texts, copies, near copies, repeated rows."""
    rng = random.Random(4)
    passage, common = words(rng, 60), words(rng, 8)
    long = words(rng, 9000)
    plain = [words(rng, rng.randint(1, 150)) for _ in range(40)]
    edited = plain[3].split()
    edited[len(edited) // 2] = "changed"
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(plain)]
    rows += [(100 + i, f"{words(rng, 20)} {passage} {words(rng, 20)}", "en", "hot") for i in range(8)]
    rows += [(120 + i, f"{words(rng, 30)}\n{common}\n{common}\n{words(rng, 30)}", "en", "hot") for i in range(8)]
    rows += [(140 + i, plain[5], "en", "hot") for i in range(12)]
    rows += [(160, " ".join(edited), None, None), (161, long, "en", "s1"), (162, long + " end", "en", "s1")]
    rows += [(163, "ab " * 400, "en", "s2"), (164, "x" * 3000, "en", "s2"), (165, "\n\n\n", "en", "s2")]
    rows += [(166, "Released under the MIT License. CC BY NC; cc by nc", "en", "s3"), (167, None, None, None)]
    rows += [(168, "", "en", "s3"), (169, "", None, ""), (None, plain[7], "en", "s0"), (None, None, None, None)]
    rows += [(170, "one", "en", "s0"), (170, "one", "en", "s0"), (171, plain[8], "en", "s0"), (171, plain[8], "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, lang, s, None if t is None else len(t), *["7"] * len(CLASHING)) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark, texts):
    sample = texts[2][1].split()
    items = [
        (1, " ".join(texts[9][1].split()[2:40])),
        (2, "released under"),
        (3, " ".join(sample[:3]) if len(sample) > 3 else "zz"),
        (4, None),
        (5, "..."),
        (None, "one"),
        (6, texts[40][1]),
        (7, texts[9][1]),
    ]
    return spark.createDataFrame(items, "item_id long, text string")
