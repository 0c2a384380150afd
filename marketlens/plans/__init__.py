"""The enriched fact and the reports built on it."""

from marketlens.plans.catalog import Report, all_reports
from marketlens.plans.fact import build_fact
from marketlens.plans.runner import report_tables, run_reports
from marketlens.plans.summary import SUMMARY_COLUMNS, build_summary
from marketlens.plans.workload import Workload

__all__ = [
    "Report",
    "SUMMARY_COLUMNS",
    "Workload",
    "all_reports",
    "build_fact",
    "build_summary",
    "report_tables",
    "run_reports",
]
