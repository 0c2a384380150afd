"""What a report reads: base tables, parameters, and the fact.

Reports are functions of the weighted fact (``plans.fact``) carrying only the
columns they need. ``Workload.fact`` builds that projection lazily from the
base tables (joining only the needed inputs), or selects it from facts that
were materialised once for a whole run of reports: one row per order for
reports that read order columns alone, one row per item for the others.

Stored facts are laid out by purchase year. ``for_years`` restricts a
workload to the rows purchased in some years (all reports then describe those
rows alone): on stored facts that is partition pruning, on base tables a date
range that reaches the scan of the orders.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import year_of
from marketlens.params import ReportParams
from marketlens.plans.fact import ITEM_COLS, SCORE_N, SCORE_SUM, WEIGHT, build_fact, order_grain
from marketlens.plans.summary import (
    PRODUCT_COLS,
    SELLER_COLS,
    SUMMARY_COLUMNS,
    build_summary,
    join_dimensions,
)
from marketlens.sources.sinks import materialize
from marketlens.sources.tables import MarketTables

YEAR = "purchase_year"  # partition column of a stored fact


def in_years(date: str, years: Iterable[int]) -> Column:
    """``date`` lies in one of ``years``, said as ranges that a scan can use."""
    day = F.col(date)
    ranges = [(day >= F.make_date(F.lit(y), F.lit(1), F.lit(1))) & (day < F.make_date(F.lit(y + 1), F.lit(1), F.lit(1))) for y in years]
    return reduce(or_, ranges, F.lit(False))


@dataclass(frozen=True)
class Workload:
    tables: MarketTables
    params: ReportParams = ReportParams()
    stored_fact: DataFrame | None = None  # one row per item
    stored_orders: DataFrame | None = None  # one row per order
    stored_paths: tuple[str, ...] = ()
    years: tuple[int, ...] | None = None

    def for_years(self, *years: int) -> Workload:
        """This workload over the rows purchased in ``years`` only."""
        return replace(self, years=tuple(years))

    def _stored(self, cols: list[str]) -> DataFrame | None:
        if self.stored_orders is not None and order_grain(cols):
            if not set(cols) - {"review_score"} - set(self.stored_orders.columns):
                return self.stored_orders
        return self.stored_fact

    def fact(self, *columns: str, weighted: bool = True) -> DataFrame:
        cols = list(columns) if columns else list(SUMMARY_COLUMNS)
        stored = self._stored(cols)
        if stored is None:
            if self.years is None:
                return build_fact(self.tables, cols, weighted)
            dated = build_fact(self.tables, [*cols, *({"purchase_date"} - set(cols))], weighted)
            return dated.filter(in_years("purchase_date", self.years)).select(*self._columns(cols))
        if self.years is not None:
            wanted = F.col(YEAR).isin(*self.years) if YEAR in stored.columns else in_years("purchase_date", self.years)
            stored = stored.filter(wanted)
        dims = set(cols) & (PRODUCT_COLS | SELLER_COLS)
        if dims:
            # The stored fact has no dimension attributes: join them here (only
            # checks that need them per item row ask for them).
            stored = join_dimensions(self.tables, stored, dims)
        return stored.select(*self._columns(cols))

    @staticmethod
    def _columns(cols: list[str]) -> list[str]:
        scores = [SCORE_SUM, SCORE_N] if "review_score" in cols else []
        return [c for c in cols if c != "review_score"] + [WEIGHT, *scores]

    def _materialized(self, spark: SparkSession, cols: Iterable[str], name: str) -> tuple[DataFrame, str]:
        cols = list(cols)
        fact = self.fact(*cols)
        by = ()
        if "purchase_date" in cols:
            fact, by = fact.withColumn(YEAR, year_of("purchase_date").cast("int")), (YEAR,)
        return materialize(spark, fact, name, by)

    def with_stored_fact(self, spark: SparkSession, columns: Iterable[str] | None = None) -> Workload:
        """Materialise the item-grain fact once below ``spark.checkpoint.dir``,
        with ``columns`` (default: all); ``stored_paths`` says where.

        Product and seller attributes are left out: reports attach them after
        aggregating, so materialising never joins a dimension at item grain.
        """
        need = set(SUMMARY_COLUMNS if columns is None else columns)
        if need & PRODUCT_COLS:
            need.add("product_id")
        if need & SELLER_COLS:
            need.add("seller_id")
        if not need & (ITEM_COLS - PRODUCT_COLS - SELLER_COLS):
            need.add("order_item_id")  # one row per item is what is asked for
        cols = [c for c in SUMMARY_COLUMNS if c in need - PRODUCT_COLS - SELLER_COLS]
        stored, path = self._materialized(spark, cols, "fact")
        return replace(self, stored_fact=stored, stored_paths=(*self.stored_paths, path))

    def with_stored_orders(self, spark: SparkSession, columns: Iterable[str]) -> Workload:
        """Materialise the order-grain fact with ``columns``, all of an order."""
        cols = [c for c in SUMMARY_COLUMNS if c in set(columns)]
        if not order_grain(cols):
            raise ValueError(f"columns of items: {sorted(set(cols) & ITEM_COLS)}")
        stored, path = self._materialized(spark, cols, "orders")
        return replace(self, stored_orders=stored, stored_paths=(*self.stored_paths, path))

    def register_views(self, prefix: str = "") -> None:
        """CREATE VIEW: expose the base tables under their export names and
        the row-level fact as ``summary`` to ``spark.sql`` (temp views are
        plans, not copies)."""
        self.tables.register_views(prefix)
        build_summary(self.tables).createOrReplaceTempView(prefix + "summary")
