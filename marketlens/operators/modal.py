"""Modal row: the most frequent tuple of attributes per key.

Both steps are aggregations, so Spark combines them map-side: a key holding
a third of all rows is reduced to one row per (key, tuple) per task before
anything is shuffled, and the pick is a ``min_by`` that also combines
partially. Nothing is sorted per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def modal_row(
    df: DataFrame,
    key: str | Sequence[str],
    value_cols: Sequence[str],
    tie_cols: Sequence[str] | None = None,
) -> DataFrame:
    """One row per ``key`` holding the most frequent ``value_cols`` tuple.

    Ties go to the smallest tuple (column by column, NULL first), compared by
    ``tie_cols`` (some of ``value_cols``) before the others. NULL attributes of the winning tuple stay NULL: the whole tuple is picked.
    """
    keys, values = _as_list(key), list(value_cols)
    counted = df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_n"))
    ranked = [*(tie_cols or ()), *[c for c in values if c not in (tie_cols or ())]]
    if set(ranked) != set(values):
        raise ValueError("tie_cols must be value columns")
    order = F.struct((-F.col("_n")).alias("_neg_n"), *[F.col(c) for c in ranked])
    picked = counted.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in values]), order).alias("_win")
    )
    return picked.select(*keys, *[F.col(f"_win.{c}").alias(c) for c in values])


def mode_value(
    df: DataFrame, group: str | Sequence[str], value: str, name: str | None = None
) -> DataFrame:
    """Most frequent ``value`` per ``group``; the smallest value on a tie
    (what an ordered-set MODE() returns). NULL values are not counted."""
    groups = _as_list(group)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    order = F.struct((-F.col("_n")).alias("_neg_n"), F.col(value))
    return counted.groupBy(*groups).agg(
        F.min_by(F.col(value), order).alias(name or f"mode_{value}")
    )
