"""Run the whole workload: every report written as a table.

The original script creates one table per report, each re-reading the fact
view. Here the facts are materialised once below ``spark.checkpoint.dir``: one
row per order with the columns of the chosen reports that read orders alone,
one row per item with those of the others (neither if no report reads it).
Every report is computed from them and written with its save mode (``ignore`` = CREATE TABLE IF NOT EXISTS, keeping a stale table;
``errorifexists`` = plain CREATE TABLE AS; default ``overwrite``), and the facts
are removed at the end. A report appears only when it is whole (``sinks``). Reports that the script builds from other reports
(``Report.reads``) read the stored ones, stale or not, and are computed from
the fact only where one of those is not stored. Intermediate parts
(``<table>__<part>``) are skipped unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from marketlens.plans.catalog import all_reports
from marketlens.plans.fact import order_grain
from marketlens.plans.workload import Workload
from marketlens.sources.sinks import holds_table, remove, save_table, stored_table, write_report

# Cross-engine checks of the fact, not report tables.
CHECKS = ("summary", "summary_fingerprint")


def report_tables() -> list[str]:
    """Names of the report tables (intermediate parts and checks excluded)."""
    return [n for n in all_reports() if "__" not in n and n not in CHECKS]


def script_modes() -> dict[str, str]:
    """The modes of the original: two plain CREATE TABLE AS, the others IF NOT EXISTS."""
    plain = ("geolocation_dataset", "top_summary")
    return {n: "errorifexists" if n in plain else "ignore" for n in report_tables()}


def run_reports(
    spark: SparkSession,
    workload: Workload,
    out_root: str,
    names: Iterable[str] | None = None,
    mode: str = "overwrite",
    modes: Mapping[str, str] | None = None,
    database: str | None = None,
) -> dict[str, str]:
    """Write each report to ``<out_root>/<name>``; returns name -> path.

    ``modes`` overrides ``mode`` by report name. With ``database`` each report
    is also the catalog table ``<database>.<name>`` over its path. Facts that
    ``workload`` already stores are read, not written again.
    """
    reports = all_reports()
    chosen = list(names) if names is not None else report_tables()
    unknown = (set(chosen) | set(modes or ())) - set(reports)
    if unknown:
        raise ValueError(f"unknown reports: {sorted(unknown)}")
    out_root = out_root.rstrip("/")
    paths = {name: f"{out_root}/{name}" for name in chosen}
    mode_of = {name: (modes or {}).get(name, mode) for name in chosen}
    # IF NOT EXISTS: what is there stays, so it need not be computed.
    kept = {n for n in chosen if mode_of[n] == "ignore" and holds_table(spark, paths[n])}
    todo = sorted((n for n in chosen if n not in kept), key=lambda n: bool(reports[n].reads))

    def inputs(name: str) -> list[DataFrame] | None:
        found = [stored_table(spark, f"{out_root}/{n}") for n in reports[name].reads]
        return found if found and all(df is not None for df in found) else None

    def from_stored(name: str) -> bool:
        need = reports[name].reads
        return bool(need) and all(n in todo or holds_table(spark, f"{out_root}/{n}") for n in need)

    read = [reports[n].fact_columns for n in todo if not from_stored(n) and reports[n].fact_columns]
    by_order = {c for cols in read if order_grain(cols) for c in cols}
    by_item = {c for cols in read if not order_grain(cols) for c in cols}
    w = workload
    try:
        if by_order and w.stored_orders is None and w.stored_fact is None:
            w = w.with_stored_orders(spark, by_order)
        if by_item and w.stored_fact is None:
            w = w.with_stored_fact(spark, by_item)
        for name in todo:
            given = inputs(name)
            # monthly_customer and payment_summary carry their presentation
            # order already (a range-partitioned sort): files are written in it.
            df = reports[name].build(w) if given is None else reports[name].from_stored(*given)
            if database is None:
                write_report(df, paths[name], mode=mode_of[name])
            else:
                save_table(df, f"{database}.{name}", mode=mode_of[name], path=paths[name])
    finally:
        for path in set(w.stored_paths) - set(workload.stored_paths):
            remove(spark, path)
    return paths
