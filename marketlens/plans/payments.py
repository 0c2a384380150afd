"""Payment type usage (reads payments and orders, not the fact)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import year_of
from marketlens.operators import pivot_count, share_of_total
from marketlens.params import ReportParams
from marketlens.sources.tables import MarketTables


def payment_dates(t: MarketTables, p: ReportParams) -> DataFrame:
    """Payment rows (excluded type and NULL type dropped) with the year of
    their order's estimated delivery (NULL when the order is missing)."""
    pays = t.payments.filter(F.col("payment_type") != p.excluded_payment_type).select(
        "order_id", "payment_type"
    )
    orders = t.orders.select(
        "order_id", year_of("order_estimated_delivery_date").alias("est_delivery_year")
    )
    return pays.join(orders, "order_id", "left")


def _payment_counts(t: MarketTables, p: ReportParams) -> DataFrame:
    return pivot_count(
        payment_dates(t, p),
        "payment_type",
        "est_delivery_year",
        list(p.payment_years),
        "total_transaction",
    )


def payment_summary(t: MarketTables, p: ReportParams) -> DataFrame:
    """Payment rows per type: all years, and one column per chosen year."""
    return _payment_counts(t, p).orderBy(F.col("total_transaction").desc())


def payment_percentage(t: MarketTables, p: ReportParams) -> DataFrame:
    """Each type's share of all counted payment rows, 1 decimal. Counted from
    the payments alone: an order has one row in ``orders``, so joining them
    would change no count."""
    counts = (
        t.payments.filter(F.col("payment_type") != p.excluded_payment_type)
        .groupBy("payment_type")
        .agg(F.count("*").alias("total_transaction"))
    )
    return share_of_total(counts, "total_transaction", 1, "percentage")


def percentage_of(summary: DataFrame) -> DataFrame:
    """``payment_percentage`` of a stored ``payment_summary``."""
    counts = summary.select("payment_type", "total_transaction")
    return share_of_total(counts, "total_transaction", 1, "percentage")
