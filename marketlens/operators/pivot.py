"""Count pivot with a row total, in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_count(
    df: DataFrame,
    row: str | Sequence[str],
    col: str,
    values: Sequence[object],
    total_name: str,
) -> DataFrame:
    """Per ``row``: total row count and one count column per pivot value.

    A cell with no rows is NULL, not 0 (as a left join of per-value counts
    gives). Values outside ``values`` count only in the total. One
    aggregation with conditional sums: a single scan and a partial
    aggregate, instead of one filtered copy per value.
    """
    rows = [row] if isinstance(row, str) else list(row)
    aggs = [F.count(F.lit(1)).alias(total_name)]
    for v in values:
        hit = F.when(F.col(col) == F.lit(v), F.lit(1))
        aggs.append(F.sum(hit).cast("long").alias(str(v)))
    return df.groupBy(*rows).agg(*aggs)
