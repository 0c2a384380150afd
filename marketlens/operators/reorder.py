"""Re-order ranking: how often customers bought the same thing again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.ranking import top_k_per_group


def reorder_top_k(
    df: DataFrame,
    period: str,
    customer: str,
    keys: Sequence[str],
    k: int = 3,
    rank_col: str = "yearly_rank",
    total_name: str = "total_reorder",
    weight: str | None = None,
) -> DataFrame:
    """Per ``period``, the top-k ``keys`` by re-orders, ties kept.

    Rows per (period, customer, keys) are counted (or their ``weight``
    summed); groups with more than one row contribute ``count - 1``
    re-orders to their ``keys``. Both steps are
    partial aggregations, and tied rows are never sorted (``top_k_per_group``).
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    per_customer = df.groupBy(period, customer, *keys).agg(rows.alias("_n"))
    reorders = (
        per_customer.filter(F.col("_n") > 1)
        .groupBy(period, *keys)
        .agg(F.sum(F.col("_n") - 1).alias(total_name))
    )
    return top_k_per_group(reorders, [period], total_name, k, rank_col)
