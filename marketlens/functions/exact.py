"""Exact half-up rounding of ratios of non-negative integers.

Averages and percentages in the reports are rounded with half away from
zero on exact numbers. Floating point ``round(avg(x), k)`` differs between
engines on halves (1.005 -> 1.01 or 1.0), so every ratio is computed on
integers: ``round(num / den, k) = (2 * num * 10^k + den) div (2 * den)``,
then divided by ``10^k`` once for display. All numerators in the reports
are counts, sums of counts, scores or day gaps, hence non-negative.

The products are formed in DECIMAL(38,0), so they cannot overflow for any
realistic count (a 64-bit ``2 * num * 10^5`` would stop at ~4.6e13 rows);
the quotient is a 64-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _long(c: Column | str) -> Column:
    return _col(c).cast("long")


def _wide(c: Column | str) -> Column:
    return _col(c).cast("decimal(38,0)")


def scaled_half_up(num: Column | str, den: Column | str, dp: int) -> Column:
    """``round(num / den, dp) * 10^dp`` as an exact long; NULL if den is 0/NULL."""
    n, d = _wide(num), _wide(den)
    safe_d = F.when(d != 0, d)
    two_scale = F.lit(2 * 10**dp).cast("decimal(38,0)")
    two = F.lit(2).cast("decimal(38,0)")
    return F.call_function("div", n * two_scale + safe_d, safe_d * two).cast("long")


def descale(scaled: Column | str, dp: int) -> Column:
    """Display value (double) of a long scaled by ``10^dp``."""
    return (_long(scaled).cast("double") / float(10**dp)).cast("double")


def ratio_half_up(num: Column | str, den: Column | str, dp: int) -> Column:
    """``round(num / den, dp)`` half-up, exact, as double."""
    return descale(scaled_half_up(num, den, dp), dp)


def percent_half_up(num: Column | str, den: Column | str, dp: int) -> Column:
    """``round(num / den * 100, dp)`` half-up, exact, as double."""
    return ratio_half_up(_wide(num) * F.lit(100).cast("decimal(38,0)"), den, dp)
