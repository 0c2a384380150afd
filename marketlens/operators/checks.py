"""Data checks (the original script's eyeball SELECT *, made assertable)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their counts.

    An aggregation (combined map-side); an empty result means ``keys`` is
    unique. Use ``.isEmpty()`` or ``.limit(n)`` to inspect, never collect
    the table.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
