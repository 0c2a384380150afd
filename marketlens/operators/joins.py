"""Joining per-period report parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_join(
    base: DataFrame, others: Sequence[DataFrame], on: str | Sequence[str] = "date_year"
) -> DataFrame:
    """Left-join report parts onto ``base`` by plain key equality.

    The base decides which periods appear. A NULL period never matches
    (NULL = NULL is not true), and several matching rows multiply. Parts
    are per-period aggregates, so AQE broadcasts them from their measured
    size; no hint is needed.

    The keys are compared as ``coalesce(base, -1) = coalesce(part, -2)``: the
    same matches (periods are positive), but nothing from which "the part's
    key is not null" could be inferred and pushed into its source. Such a
    filter would make the parts' sources differ, and Spark could no longer
    compute them once and share them.
    """
    keys = [on] if isinstance(on, str) else list(on)
    out = base
    for part in others:
        renamed = part.withColumnsRenamed({k: f"_part_{k}" for k in keys})
        same = [F.coalesce(F.col(k), F.lit(-1)) == F.coalesce(F.col(f"_part_{k}"), F.lit(-2)) for k in keys]
        out = out.join(renamed, reduce(and_, same), "left").drop(*(f"_part_{k}" for k in keys))
    return out
