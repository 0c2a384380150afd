"""Every report of the workload, by name.

Names are the original report tables; ``<table>__<part>`` are their
intermediate results, exposed so each can be checked on its own. Each
entry states the fact columns it reads (the fact is built with exactly
those) or reads base tables directly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from marketlens.plans import customers, fingerprint, geo, origin, payments, products
from marketlens.plans.dimensions import Dimensions
from marketlens.plans.summary import build_summary
from marketlens.plans.workload import Workload


@dataclass(frozen=True)
class Report:
    name: str
    build: Callable[[Workload], DataFrame]
    fact_columns: tuple[str, ...] | None  # None: reads base tables
    reads: tuple[str, ...] = ()  # reports that the script builds it from
    from_stored: Callable[..., DataFrame] | None = None  # it, of those tables


def _fact(name: str, cols: tuple[str, ...], fn, weighted: bool = True) -> Report:
    """``weighted=False``: the report asks which values occur, never how many
    rows there are, so the reviews (the rows' weights) are not read."""
    return Report(name, lambda w: fn(w.fact(*cols, weighted=weighted), w.params), tuple(cols))


def _fact_dims(name: str, cols: tuple[str, ...], fn, weighted: bool = True) -> Report:
    """A report that attaches product / seller attributes after aggregating."""
    return Report(
        name,
        lambda w: fn(w.fact(*cols, weighted=weighted), w.params, Dimensions.of(w.tables)),
        tuple(cols),
    )


def _tables(name: str, fn) -> Report:
    return Report(name, lambda w: fn(w.tables, w.params), None)


def _origin_reports(side: str, table: str) -> list[Report]:
    cols = origin.origin_cols(side)
    share = origin.share_cols(side)
    if side == "customer":
        city = ("city", 3, "total_cities")
        state = ("state", 3, "total_states")
    else:
        city = ("city", 2, "total_cities")
        state = ("state", 2, "total_state")
    by_order = origin.order_cols(side)
    return [
        Report(
            table,
            lambda w: origin.origin(
                w.fact(*cols),
                side,
                w.params,
                Dimensions.of(w.tables),
                w.fact(*by_order, weighted=False) if by_order else None,
            ),
            tuple(dict.fromkeys(cols + by_order)),
        ),
        _fact_dims(
            f"{table}__total_city_state", cols, lambda s, p, d: origin.total_city_state(s, side, d)
        ),
        _fact_dims(
            f"{table}__highest_state", cols, lambda s, p, d: origin.highest_state(s, side, d)
        ),
        _fact_dims(
            f"{table}__highest_city", by_order or cols, lambda s, p, d: origin.highest_city(s, side, d), not by_order
        ),
        _fact_dims(
            f"{table}__percentage_state_city",
            cols,
            lambda s, p, d: origin.home_share(s, side, p, d),
        ),
        _fact_dims(
            f"{table}_city", share, lambda s, p, d: origin.origin_share(s, side, *city, p, d), False
        ),
        _fact_dims(
            f"{table}_state", share, lambda s, p, d: origin.origin_share(s, side, *state, p, d), False
        ),
    ]


def _revenue_double(fn):
    def run(s, p):
        df = fn(s, p)
        return df.withColumn("revenue", df["revenue"].cast("double"))

    return run


def all_reports() -> dict[str, Report]:
    g, t = customers.GROWTH_COLS, customers.TRANSACTION_COLS
    ps = products.PRODUCT_SUMMARY_COLS
    reports = [
        _tables("geolocation_dataset", lambda tables, p: geo.dedupe_geolocation(tables)),
        Report(
            "summary",
            lambda w: fingerprint.summary_rows(build_summary(w.tables), w.params),
            None,
        ),
        _fact("summary_fingerprint", fingerprint.FINGERPRINT_COLS, fingerprint.summary_fingerprint),
        _fact("yearly_customer", g, customers.yearly_customer),
        _fact("yearly_customer__avg_monthly_customer", g, customers.avg_monthly_customer, False),
        _fact("yearly_customer__new_customer", g, customers.new_customer, False),
        _fact("yearly_customer__repeat_order_cust", g, customers.repeat_order_cust),
        _fact("yearly_customer__avg_order", g, customers.avg_order),
        _fact("monthly_customer", g, customers.monthly_customer, False),
        _fact("yearly_transaction", t, customers.yearly_transaction),
        _fact("yearly_transaction__day_diff", g, customers.day_diff),
        _fact("yearly_transaction__yearly_stats", g, customers.yearly_stats),
        _fact("yearly_transaction__avg_unique_items", ("purchase_date", "order_id"), customers.avg_unique_items),
        _fact("yearly_transaction__avg_rating", ("purchase_date", "order_id", "review_score"), customers.avg_rating),
        _fact("mode_of_transaction", g, customers.mode_of_transaction),
        *_origin_reports("customer", "origin_customer"),
        _fact_dims("product_summary", ps, products.product_summary),
        _fact("product_summary__yearly_revenue", products.REVENUE_COLS, _revenue_double(products.yearly_revenue)),
        _fact("product_summary__yearly_cancel", products.CANCEL_COLS, products.yearly_cancel),
        _fact_dims("product_summary__top_product", products.REVENUE_COLS, products.top_product),
        _fact_dims("product_summary__top_cancel", products.CANCEL_COLS, products.top_cancel),
        _fact_dims(
            "top_reorder_product", products.REORDER_PRODUCT_COLS, products.top_reorder_product
        ),
        _fact_dims(
            "top_reorder_category", products.REORDER_CATEGORY_COLS, products.top_reorder_category
        ),
        _fact_dims("top_category_revenue", products.REVENUE_COLS, products.top_category_revenue),
        _fact_dims(
            "top_transaction_category", products.TRANSACTION_COLS, products.top_transaction_category
        ),
        _fact_dims("top_summary", products.TOP_SUMMARY_COLS, products.top_summary),
        *_origin_reports("seller", "origin_seller"),
        _tables("payment_summary", payments.payment_summary),
        _tables("payment_percentage", payments.payment_percentage),
    ]
    by_name = {r.name: r for r in reports}
    top = ("top_reorder_category", "top_reorder_product", "top_category_revenue", "top_transaction_category")
    for name, reads, build in (
        ("top_summary", top, products.zip_top_tables),
        ("payment_percentage", ("payment_summary",), payments.percentage_of),
    ):
        by_name[name] = replace(by_name[name], reads=reads, from_stored=build)
    return by_name
