"""Several exact distinct counts in one result, without repeating rows.

``COUNT(DISTINCT a), COUNT(DISTINCT b), SUM(x)`` in one aggregate makes Spark
expand every input row once per distinct column. ``distinct_counts`` instead
aggregates in stages: once per (group, all keys), with the sums carried along
in one struct, then once per key from those rows. The first stage combines
map-side and is one shuffle that all later stages read again, so the input is
read once however many keys are counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(
    df: DataFrame,
    group: Sequence[str],
    keys: Mapping[str, str],
    sums: Mapping[str, Column] | None = None,
    rows: Column | None = None,
) -> DataFrame:
    """Per ``group``: the number of distinct non-NULL values of each key, and sums.

    ``keys`` maps a result name to the column counted, ``sums`` a result name
    to the expression added up (NULL if no value is there, as SUM). ``rows``
    is a positive number per row (default 1). NULL groups are groups.
    """
    sums = dict(sums or {})
    columns = list(dict.fromkeys(keys.values()))
    rows = F.lit(1).cast("long") if rows is None else rows
    # Every stage filters on the row count: always true, but not known to be,
    # so that all stages read one identical first aggregate.
    carried = F.struct(F.sum(rows).alias("_rows"), *[F.sum(v).alias(n) for n, v in sums.items()])
    first = df.groupBy(*group, *columns).agg(carried.alias("_m")).filter(F.col("_m._rows") > 0)
    parts = []
    for i, column in enumerate(columns):
        per_key = [F.sum(f"_m.{n}").alias(n) for n in sums] if i == 0 else []
        per_group = [F.sum(n).alias(n) for n in sums] if i == 0 else []
        if len(columns) > 1:
            per_key = per_key or [F.count(F.lit(1)).alias("_any")]
            staged = first.groupBy(*group, column).agg(*per_key)
        else:
            staged = first.select(*group, column, *[F.col(f"_m.{n}").alias(n) for n in sums])
        counts = [F.count(column).alias(n) for n, c in keys.items() if c == column]
        parts.append(staged.groupBy(*group).agg(*counts, *per_group))
    out = parts[0]
    for part in parts[1:]:
        renamed = part.withColumnsRenamed({g: f"_part_{g}" for g in group})
        same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_part_{g}")) for g in group])
        out = out.join(renamed, same).drop(*(f"_part_{g}" for g in group))
    return out.select(*group, *keys, *sums)
