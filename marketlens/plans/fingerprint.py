"""A compact, exact fingerprint of the whole fact.

One row per (order_status, seller_state) with row counts, exact sums and
the distinct orders and customers, touching every one of the 23 summary
columns (computed on the item-grain weighted fact; dimension attributes
enter through the grouping and the NULL-sensitive sums), so two engines can agree on
the fact without shipping it. Money and weights are summed as decimals,
dates as day numbers: no floating-point sums whose value depends on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators import distinct_counts
from marketlens.params import ReportParams
from marketlens.plans.fact import SCORE_N, SCORE_SUM, WEIGHT
from marketlens.plans.summary import SUMMARY_COLUMNS

FINGERPRINT_COLS = SUMMARY_COLUMNS


def _w(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c) * F.col(WEIGHT)


def _days(c: str) -> Column:
    return _w(F.unix_date(F.col(c)))


def _money(c: str) -> Column:
    return _w(F.col(c).cast("decimal(18,2)"))


def _without(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.col(WEIGHT)).otherwise(0)


# Sums by name: expression and the type of the result.
SUMS = {
    "n_rows": (lambda: F.col(WEIGHT), "long"),
    "sum_item_id": (lambda: _w("order_item_id"), "long"),
    "sum_product_id_len": (lambda: _w(F.length("product_id")), "long"),
    "n_no_category": (lambda: _without("product_category"), "long"),
    "n_no_seller_city": (lambda: _without("seller_city"), "long"),
    "n_no_customer_state": (lambda: _without("customer_state"), "long"),
    "sum_price": (lambda: _money("price"), "double"),
    "sum_shipping_cost": (lambda: _money("shipping_cost"), "double"),
    "sum_total_cost": (lambda: _w("total_cost"), "double"),
    "n_scores": (lambda: F.col(SCORE_N), "long"),
    "sum_review_score": (lambda: F.col(SCORE_SUM), "long"),
    "sum_purchase_day": (lambda: _days("purchase_date"), "long"),
    "n_approved": (lambda: F.when(F.col("approved_date").isNotNull(), F.col(WEIGHT)).otherwise(0), "long"),
    "sum_approved_day": (lambda: _days("approved_date"), "long"),
    "sum_est_delivery_day": (lambda: _days("est_delivery_date"), "long"),
    "sum_shipping_limit_day": (lambda: _days("shipping_limit"), "long"),
    "sum_weight": (lambda: _money("product_weight_g"), "double"),
    "sum_payment_sequential": (lambda: _w("total_payment_sequential"), "long"),
    "sum_payment_installments": (lambda: _w("total_payment_installments"), "long"),
    "sum_payment_value": (lambda: _money("total_payment_value"), "double"),
}


def summary_fingerprint(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Over the item-grain fact: row counts are weight sums, sums are
    weighted sums, distinct counts are unchanged. Counted in stages per
    (order, customer), so that no item row is repeated for a distinct count."""
    group = ["order_status", "seller_state"]
    counted = distinct_counts(
        s,
        group,
        {"n_orders": "order_id", "n_customers": "customer_unique_id"},
        {name: make() for name, (make, _) in SUMS.items()},
        rows=F.col(WEIGHT),
    )
    return counted.select(
        *group, "n_orders", "n_customers", *[F.col(n).cast(kind).alias(n) for n, (_, kind) in SUMS.items()]
    )


def summary_rows(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """The row-level view itself, for cross-engine comparison: dates as ISO
    text and the decimal cost as double (the other columns as they are)."""
    cols = []
    for c in SUMMARY_COLUMNS:
        col = F.col(c)
        if c in ("purchase_date", "approved_date", "est_delivery_date", "shipping_limit"):
            col = F.date_format(col, "yyyy-MM-dd")
        elif c == "total_cost":
            col = col.cast("double")
        cols.append(col.alias(c))
    return s.select(*cols)
