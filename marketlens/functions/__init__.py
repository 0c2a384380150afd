"""Column expressions: exact ratios and calendar parts."""

from marketlens.functions.calendar import days_between, month_of, year_of
from marketlens.functions.exact import (
    descale,
    percent_half_up,
    ratio_half_up,
    scaled_half_up,
)

__all__ = [
    "days_between",
    "descale",
    "month_of",
    "percent_half_up",
    "ratio_half_up",
    "scaled_half_up",
    "year_of",
]
