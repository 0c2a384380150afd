"""Reusable DataFrame -> DataFrame analytic operators."""

from marketlens.operators.averages import two_level_avg
from marketlens.operators.checks import duplicate_keys
from marketlens.operators.distincts import distinct_counts
from marketlens.operators.events import first_event, successor, successor_gap_parts
from marketlens.operators.joins import report_join
from marketlens.operators.modal import modal_row, mode_value
from marketlens.operators.pivot import pivot_count
from marketlens.operators.positional import number_rows, zip_by_position
from marketlens.operators.ranking import top_k_per_group, top_n_threshold
from marketlens.operators.reorder import reorder_top_k
from marketlens.operators.shares import share_of_total, share_topn_others

__all__ = [
    "distinct_counts",
    "duplicate_keys",
    "first_event",
    "modal_row",
    "number_rows",
    "mode_value",
    "pivot_count",
    "reorder_top_k",
    "report_join",
    "share_of_total",
    "share_topn_others",
    "successor",
    "successor_gap_parts",
    "top_k_per_group",
    "top_n_threshold",
    "two_level_avg",
    "zip_by_position",
]
