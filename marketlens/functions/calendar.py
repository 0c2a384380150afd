"""Calendar parts used as report keys (always BIGINT, like DATE_PART)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_of(c: Column | str) -> Column:
    return F.year(_c(c)).cast("long")


def month_of(c: Column | str) -> Column:
    return F.month(_c(c)).cast("long")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from ``earlier`` to ``later`` (date minus date)."""
    return F.datediff(_c(later), _c(earlier)).cast("long")
