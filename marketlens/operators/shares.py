"""Shares of a total, and top-n-plus-others share tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import descale, scaled_half_up
from marketlens.operators.ranking import top_n_threshold


def share_of_total(
    df: DataFrame, metric: str, dp: int, name: str = "percentage"
) -> DataFrame:
    """Append ``round(metric / sum(metric) * 100, dp)`` (exact half-up).

    The total is a scalar subquery (computed once, a one-row aggregate that
    combines map-side), not an unpartitioned window.
    """
    total = df.agg(F.sum(metric)).scalar()
    return df.withColumn(
        name, descale(scaled_half_up(F.col(metric).cast("decimal(38,0)") * 100, total, dp), dp)
    )


def share_topn_others(
    df: DataFrame,
    entity_cols: Sequence[str],
    label_col: str,
    dp: int,
    count_name: str,
    n: int = 5,
    other: str = "others",
    bucket_name: str = "top_5",
) -> DataFrame:
    """Share of distinct entities per label; top-n labels by share, rest pooled.

    1. distinct ``entity_cols`` tuples (NULLs are values), counted per
       ``label_col``;
    2. each label's share of all tuples, rounded half-up to ``dp`` BEFORE
       ranking (rounding can create ties);
    3. labels whose ``rank() over (order by share desc) <= n`` keep their
       name, every other label becomes ``other`` (ties at rank n keep more
       than n names; a label equal to ``other`` or NULL merges by value);
    4. per bucket: sum of the rounded shares and number of labels.

    Shares are carried as exact integers scaled by 10^dp and summed before
    the one division for display.
    """
    per_label = (
        df.select(*entity_cols)
        .distinct()
        .groupBy(label_col)
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    total = per_label.agg(F.sum("_cnt")).scalar()

    def pct(count):
        return scaled_half_up(count * 100, total, dp)

    scaled = per_label.withColumn("_pct", pct(F.col("_cnt")))
    # Rounding is monotone, so the n-th largest rounded share is the share
    # of the n-th largest count: the threshold needs no total, and the two
    # scalar subqueries run independently.
    keep = F.col("_pct") >= pct(top_n_threshold(per_label, "_cnt", n))
    bucket = F.when(keep, F.col(label_col)).otherwise(F.lit(other))
    return scaled.groupBy(bucket.alias(bucket_name)).agg(
        descale(F.sum("_pct"), dp).alias("total_percentage"),
        F.count(F.lit(1)).alias(count_name),
    )
