"""Two-level averages: aggregate per inner group, then average per outer group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import ratio_half_up


def two_level_avg(
    df: DataFrame,
    outer: Sequence[str],
    inner: Sequence[str],
    name: str,
    dp: int,
    inner_agg: Column | None = None,
) -> DataFrame:
    """``round(avg(inner_agg per (outer, inner)), dp)`` per ``outer``.

    ``inner_agg`` defaults to ``count(*)``. Only inner groups that exist
    count (a month with no rows is not a zero). The mean is exact half-up.
    Both levels are partial aggregations.
    """
    agg = inner_agg if inner_agg is not None else F.count(F.lit(1))
    per_inner = df.groupBy(*outer, *inner).agg(agg.alias("_v"))
    return per_inner.groupBy(*outer).agg(
        ratio_half_up(F.sum("_v"), F.count("_v"), dp).alias(name)
    )
