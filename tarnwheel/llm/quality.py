"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textpass import free_name, map_texts

FEATURES = (
    "log_words",
    "word_length",
    "upper",
    "digits",
    "stops",
    "marks",
    "bars",
    "repeats",
    "top_word",
    "variety",
    "line_words",
    "same_lines",
)
STOPS = b".,;:'\"-?()"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
#: Visible ASCII that is neither letter, digit nor stop, and not the bar.
MARKS = bytes(b for b in range(33, 127) if b not in LETTERS + DIGITS + STOPS and b != 124)


def angle(part: float, whole: float) -> float:
    """Angular transform of a share: its spread hardly depends on the share or on the size of a text."""
    return math.asin(math.sqrt(min(part / whole, 1.0))) if whole else 0.0


def statistics_of(text: bytes | None) -> list[float]:
    """Transformed statistics of one whole text: logs of sizes, angles of shares."""
    text = text or b""
    size = len(text)
    words = text.split()
    n = len(words)

    def share(chars: bytes) -> float:
        return angle(size - len(text.translate(None, chars)), size)

    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split(b"\n")
    letters = size - len(text.translate(None, LETTERS))
    return [
        math.log1p(n),
        math.log1p((size - n) / n) if n else 0.0,
        angle(size - len(text.translate(None, UPPER)), letters),
        share(DIGITS),
        share(STOPS),
        share(MARKS),
        share(b"|"),
        angle(sum(map(eq, words, words[1:])), n),
        angle(max(counts.values(), default=0), n),
        math.log((len(counts) + 0.5) / (n + 0.5)),
        math.log1p(n / len(lines)),
        angle(sum(a == b for a, b in pairwise(lines)), len(lines)),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the vector ``features`` of every row."""
    return map_texts(
        docs,
        {id_col: id_col},
        text_col,
        lambda: lambda text: (statistics_of(text),),
        T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))]),
    )


@dataclass(frozen=True)
class Discriminant:
    """Means, shrunk covariances and priors of the two classes; ``None`` means: too few examples of one class."""

    means: np.ndarray | None
    covariances: np.ndarray | None
    counts: tuple[int, int]

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """Inverse Cholesky factor and log determinant of each class, computed once."""
        out = []
        for c in self.covariances:
            lower = np.linalg.cholesky(c)
            out.append((np.linalg.inv(lower), 2 * float(np.log(np.diag(lower)).sum())))
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, plus the log odds of the classes."""
        n0, n1 = self.counts
        prior = math.log((n1 + 1) / (n0 + 1))
        if self.means is None:
            return np.full(len(x), prior)
        density = []
        for mean, (inverse, log_det) in zip(self.means, self.factors, strict=True):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * ((z * z).sum(axis=1) + log_det))
        return density[1] - density[0] + prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1.  The log odds of normal densities are too sure far away, so asinh flattens
        them; it keeps their order and sign and hardly changes odds near 1."""
        return 1 / (1 + np.exp(-np.arcsinh(self.log_odds(x))))


def fit(labelled: DataFrame, shrinkage: float = 0.05, label_col: str = "label") -> Discriminant:
    """Fit on rows with ``features`` and a 0/1 label (others are ignored).

    Counts, sums and cross products are Spark sums, combined in the map tasks;
    the driver gets one row per class.  Each covariance is the class's own,
    pulled towards the diagonal of the pooled one by ``shrinkage``.
    """
    p = len(FEATURES)
    x: list[Column] = [F.col("features")[i] for i in range(p)]
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in cells]
    rows = (
        labelled.where(F.col(label_col).isin(0, 1))
        .groupBy(label_col)
        .agg(F.count(F.lit(1)).alias("n"), *sums, *products)
        .collect()
    )
    found = {r[label_col]: r for r in rows}
    counts = tuple(int(found[c]["n"]) if c in found else 0 for c in (0, 1))
    if min(counts) < 2:
        return Discriminant(None, None, counts)
    means, scatter = [], []
    for c in (0, 1):
        r = found[c]
        mean = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
        second = np.zeros((p, p))
        for i, j in cells:
            second[i, j] = second[j, i] = r[f"q{i}_{j}"] / r["n"]
        means.append(mean)
        scatter.append(second - np.outer(mean, mean))
    pooled = (scatter[0] * counts[0] + scatter[1] * counts[1]) / sum(counts)
    target = np.diag(np.maximum(np.diag(pooled), 1e-6))
    return Discriminant(
        np.array(means), np.array([(1 - shrinkage) * s + shrinkage * target for s in scatter]), counts
    )


def score(features: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` of every row of ``features``."""
    chosen = features.select(*keep, "features")
    schema = T.StructType(
        [f for f in chosen.schema.fields if f.name != "features"] + [T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            flat = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False)
            made = model.scores(flat.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(made, type=pa.float64())], names=[*keep, "score"]
            )

    return chosen.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: CRC-32 of the id as text is a multiple of 5 (a null id counts as empty text)."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def teach(
    features: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", shrinkage: float = 0.05
) -> Discriminant:
    """A model of the labelled rows of ``features`` that are not held out; null labels and ids teach nothing."""
    known = labels.select(F.col(id_col), F.col(label_col).alias("label")).where(F.col(label_col).isNotNull())
    return fit(features.where(~held_out(id_col)).join(known, id_col), shrinkage)


def quality_scores(
    features: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    label_col: str = "quality",
    shrinkage: float = 0.05,
    threshold: float = 0.3,
) -> DataFrame:
    """Scores of all rows of ``features`` by a model learnt from the labelled rows not held out.

    Null and empty texts have the statistics of an empty text.  Rows with
    equal ids are all scored; an id that is labelled twice teaches twice, null
    labels and ids teach nothing.  Without two examples of each class the
    score is the smoothed share of label 1.  Empty input gives an empty result.
    """
    model = teach(features, labels, id_col=id_col, label_col=label_col, shrinkage=shrinkage)
    scored = score(features, model, [id_col])
    return scored.select(
        id_col,
        held_out(id_col).alias("held_out"),
        "score",
        (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """The documents with a score of at least ``threshold``, by a model learnt from those among them that have labels.

    The statistics are made once for the model and once more where the texts
    are filtered, so no text is shuffled.  Null texts are judged as empty ones.
    """
    model = teach(with_statistics(docs, id_col, text_col), labels, id_col=id_col)
    name = free_name(docs, "score")

    def judge(text: bytes | None) -> tuple[float]:
        return (float(model.scores(np.array([statistics_of(text)]))[0]),)

    columns = {c: c for c in docs.columns}
    scored = map_texts(docs, columns, text_col, lambda: judge, T.StructType([T.StructField(name, T.DoubleType())]))
    return scored.where(F.col(name) >= F.lit(threshold)).drop(name)
