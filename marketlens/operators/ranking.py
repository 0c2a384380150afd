"""Rank-based top-k.

``top_k_per_group`` keeps ties (RANK, not ROW_NUMBER) and never sorts tied
rows. A row ranks within the first k only if its metric is among the k
largest *distinct* values of its group, so the rank is found on those: rows
are counted per (group, metric) (partial aggregation), a group-limited window
keeps k of these values per group and task, and running counts over at most k
rows per group give each value its rank. The rows themselves meet that small
table in a null-safe join and may be as many as they like: a million rows
tied at rank 1 stay in the tasks they are in.

``top_n_threshold`` replaces a global (unpartitioned) RANK: ``rank(v) <= n``
holds exactly when ``v`` is at least the n-th largest value counted with
multiplicity. That value is a global top-n (partial top-n per task, n rows
per task merged), returned as a scalar subquery, so no window ever pulls
all rows into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_limits(df: DataFrame, group: Sequence[str], metric: str, k: int, rank_col: str) -> DataFrame:
    """(group, metric, rank) of the values that rank k or better, at most k per group.

    Descending RANK with a NULL metric first; NULL groups are groups.
    """
    best_first = Window.partitionBy(*group).orderBy(F.col(metric).desc_nulls_first())
    before = best_first.rowsBetween(Window.unboundedPreceding, -1)
    counted = df.groupBy(*group, metric).agg(F.count(F.lit(1)).alias("_rows"))
    largest = counted.withColumn("_nth", F.row_number().over(best_first)).filter(F.col("_nth") <= k)
    ahead = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    return (
        largest.withColumn(rank_col, (ahead + 1).cast("long"))
        .filter(F.col(rank_col) <= k)
        .select(*group, metric, rank_col)
    )


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    metric: str,
    k: int,
    rank_col: str = "yearly_rank",
) -> DataFrame:
    """Rows whose ``rank()`` within ``group`` by ``metric`` is <= k (ties kept).

    Largest first, a NULL metric before all others. ``rank_col`` is a BIGINT.
    ``df`` is read twice; it should end in an aggregate, whose shuffle both
    readings share.
    """
    limits = rank_limits(df, group, metric, k, rank_col)
    keys = [*group, metric]
    limits = limits.withColumnsRenamed({c: f"_limit_{c}" for c in keys})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_limit_{c}")) for c in keys])
    return df.join(limits, same, "inner").select(*df.columns, rank_col)


def top_n_threshold(df: DataFrame, value: str, n: int) -> Column:
    """Scalar subquery: the n-th largest ``value`` (with multiplicity).

    With fewer than n rows this is the smallest value, so every row passes.
    NULL values are ignored.
    """
    top = (
        df.select(value)
        .filter(F.col(value).isNotNull())
        .orderBy(F.col(value).desc())
        .limit(n)
    )
    return top.agg(F.min(value)).scalar()
