"""Equi-joins with predictable column names.

The result has the left columns in their order, then the right columns without
the right key.  A right column whose name the left side already has gets a
suffix, so the plain name always means the left column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Names = str | Sequence[str]
RIGHT_KEY = "__right_{}"


def _names(value: Names) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def join_suffix(
    left: DataFrame,
    right: DataFrame,
    on: Names | None = None,
    *,
    left_on: Names | None = None,
    right_on: Names | None = None,
    how: str = "inner",
    suffix: str = "_right",
) -> DataFrame:
    """Join on one or more key pairs; see the module text for the column rule.

    ``how`` is ``inner``, ``left`` or ``anti``.  Renaming happens before the
    join, so self-joins and repeated dimensions need no aliases.
    """
    left_keys = _names(on if on is not None else left_on)
    right_keys = _names(on if on is not None else right_on)
    if how == "anti":
        return anti_join(left, right, left_keys, right_keys)
    renamed = {key: RIGHT_KEY.format(i) for i, key in enumerate(right_keys)}
    kept = []
    for name in right.columns:
        if name not in renamed:
            kept.append(name + suffix if name in left.columns else name)
    clashes = {n for n in kept if n in left.columns or kept.count(n) > 1}
    if clashes:
        raise ValueError(f"column names {sorted(clashes)} occur twice; choose another suffix than {suffix!r}")
    right = right.select(
        [
            F.col(f"`{name}`").alias(
                renamed.get(name) or (name + suffix if name in left.columns else name)
            )
            for name in right.columns
        ]
    )
    condition = [F.col(f"`{lk}`") == F.col(RIGHT_KEY.format(i)) for i, lk in enumerate(left_keys)]
    return left.join(right, condition, how).select([F.col(f"`{n}`") for n in [*left.columns, *kept]])


def anti_join(
    left: DataFrame, right: DataFrame, left_keys: Names, right_keys: Names | None = None
) -> DataFrame:
    """Left rows without a partner.

    The right side is reduced to its distinct keys first: map-side combine
    removes repeated keys before the shuffle, however often one of them occurs.
    """
    left_keys = _names(left_keys)
    right_keys = _names(right_keys or left_keys)
    keys = right.select(
        [F.col(f"`{k}`").alias(RIGHT_KEY.format(i)) for i, k in enumerate(right_keys)]
    ).distinct()
    condition = [F.col(f"`{lk}`") == F.col(RIGHT_KEY.format(i)) for i, lk in enumerate(left_keys)]
    return left.join(keys, condition, "left_anti")
