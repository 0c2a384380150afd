"""The enriched order-item fact (``summary``).

Grain: one row per order item x review of its order (an order with two
reviews repeats its items; an order with none keeps them once). Items are
the driving table: orders without items do not appear, items whose order,
product or seller is missing survive with NULLs. Payment columns are
order-level totals repeated on every item row.

Plan shape
----------
Every input is shuffled once on its join key; no join leaves a hot key in
one task (a single order, customer or review group may hold a third of all
rows):

* ``order_level``: orders (with their customer) and payment totals, one row
  per order. Orders meet customers in a left join on ``customer_id`` whose
  preserved side (orders) adaptive execution can split.
* ``order_side``: ``reviews LEFT JOIN order_level`` (reviews are the
  preserved, splittable side) plus ``order_level`` rows whose order has no
  review (anti join against the distinct review keys, which are reduced
  map-side before they are shuffled). Together this is the full outer join,
  one row per (order, review).
* the fact: ``items INNER JOIN order_side`` -- an inner join, so adaptive
  execution may split a hot order on either side -- plus the items whose
  order appears nowhere (anti join against the distinct order keys), with
  NULL order attributes, plus items without an order id (a pushed-down
  IS NULL scan, never shuffled). Together this is ``items LEFT JOIN
  order_side``; the inner and the anti join read one shared item shuffle.

Product and seller attributes join last on their own keys; Spark broadcasts
them only when their measured size is under the broadcast threshold and
shuffles (with skew splitting on the item side) otherwise.

Only the inputs whose columns a report asks for are joined (``columns``).
Dimension keys (order, customer, product, seller ids) are primary keys of
their tables, so dropping an unread dimension never changes row counts.
Reviews are always joined: they set the grain.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.tables import MarketTables

SUMMARY_COLUMNS: tuple[str, ...] = (
    "order_id",
    "product_id",
    "order_item_id",
    "seller_id",
    "product_category",
    "price",
    "shipping_cost",
    "total_cost",
    "order_status",
    "review_score",
    "purchase_date",
    "approved_date",
    "est_delivery_date",
    "shipping_limit",
    "product_weight_g",
    "seller_city",
    "seller_state",
    "customer_unique_id",
    "customer_city",
    "customer_state",
    "total_payment_sequential",
    "total_payment_installments",
    "total_payment_value",
)

ORDER_COLS = {"order_status", "purchase_date", "approved_date", "est_delivery_date"}
CUSTOMER_COLS = {"customer_unique_id", "customer_city", "customer_state"}
PRODUCT_COLS = {"product_category", "product_weight_g"}
SELLER_COLS = {"seller_city", "seller_state"}
PAYMENT_COLS = {
    "total_payment_sequential",
    "total_payment_installments",
    "total_payment_value",
}

_ORDER_SOURCE = {
    "order_status": "order_status",
    "purchase_date": "order_purchase_timestamp",
    "approved_date": "order_approved_at",
    "est_delivery_date": "order_estimated_delivery_date",
}


def _items(t: MarketTables, need: set[str]) -> DataFrame:
    exprs = {
        "order_id": F.col("order_id"),
        "product_id": F.col("product_id"),
        "order_item_id": F.col("order_item_id"),
        "seller_id": F.col("seller_id"),
        "price": F.col("price"),
        "shipping_cost": F.col("freight_value"),
        # ROUND((price + freight)::numeric, 2): a double sum rounded half-up
        # to an exact decimal.
        "total_cost": (F.col("price") + F.col("freight_value")).cast("decimal(18,2)"),
        "shipping_limit": F.col("shipping_limit_date"),
    }
    wanted = [c for c in exprs if c in need or c in ("order_id", "product_id", "seller_id")]
    return t.items.select(*[exprs[c].alias(c) for c in wanted])


def order_level(t: MarketTables, need: set[str]) -> DataFrame | None:
    """One row per order: order attributes, customer attributes, payment
    totals (only those in ``need``); None when none is needed."""
    level: DataFrame | None = None
    if need & (ORDER_COLS | CUSTOMER_COLS):
        cols = [F.col("order_id")]
        cols += [F.col(src).alias(dst) for dst, src in _ORDER_SOURCE.items() if dst in need]
        if need & CUSTOMER_COLS:
            cols.append(F.col("customer_id"))
        level = t.orders.select(*cols)
        if need & CUSTOMER_COLS:
            customers = t.customers.select(
                "customer_id", *[c for c in sorted(CUSTOMER_COLS) if c in need]
            )
            level = level.join(customers, "customer_id", "left").drop("customer_id")
    if need & PAYMENT_COLS:
        # Pre-aggregated per order (combined map-side): no payment fan-out.
        payments = t.payments.groupBy("order_id").agg(
            F.count("payment_sequential").alias("total_payment_sequential"),
            F.sum("payment_installments").alias("total_payment_installments"),
            # Exact whatever the order of the rows: money is added as decimals.
            F.sum(F.col("payment_value").cast("decimal(18,2)")).cast("double").alias("total_payment_value"),
        )
        # Both sides hold at most one row per order: no hot key possible.
        level = payments if level is None else level.join(payments, "order_id", "full")
    return level


def order_side(t: MarketTables, need: set[str]) -> DataFrame:
    """Order-grain attributes, one row per (order, review): the full outer
    join of ``order_level`` and reviews, written as a left join from the
    reviews plus the unreviewed orders."""
    review_cols = ["order_id"] + (["review_score"] if "review_score" in need else [])
    # A NULL order id never matches an item: such rows are dropped up
    # front, which also gives both uses of each input one identical
    # (reusable) shuffle.
    reviews = t.reviews.select(*review_cols).filter(F.col("order_id").isNotNull())
    level = order_level(t, need)
    if level is None:
        return reviews
    level = level.filter(F.col("order_id").isNotNull())
    reviewed = reviews.join(level, "order_id", "left")
    review_keys = reviews.select("order_id").distinct()
    unreviewed = level.join(review_keys, "order_id", "left_anti")
    return reviewed.unionByName(unreviewed, allowMissingColumns=True)


def join_dimensions(t: MarketTables, fact: DataFrame, need: set[str]) -> DataFrame:
    """Left-join product and seller attributes (only when needed)."""
    if need & PRODUCT_COLS:
        products = t.products.select(
            "product_id",
            *(
                [F.col("product_category_name").alias("product_category")]
                if "product_category" in need
                else []
            ),
            *(["product_weight_g"] if "product_weight_g" in need else []),
        )
        fact = fact.join(products, "product_id", "left")
    if need & SELLER_COLS:
        sellers = t.sellers.select(
            "seller_id", *[c for c in ("seller_city", "seller_state") if c in need]
        )
        fact = fact.join(sellers, "seller_id", "left")
    return fact


def order_side_keys(t: MarketTables, need: set[str]) -> DataFrame:
    """Distinct order ids present in ``order_side``, read from the sources'
    key columns (reduced map-side), without re-running its joins."""
    keys = t.reviews.select("order_id")
    if need & (ORDER_COLS | CUSTOMER_COLS):
        keys = keys.unionByName(t.orders.select("order_id"))
    if need & PAYMENT_COLS:
        keys = keys.unionByName(t.payments.select("order_id"))
    return keys.filter(F.col("order_id").isNotNull()).distinct()


def build_summary(
    t: MarketTables, columns: Iterable[str] | None = None, dedupe_reviews: bool = False
) -> DataFrame:
    """The fact with ``columns`` (default: all 23, in the original order).

    ``dedupe_reviews`` keeps one row per item: of an order's reviews the one
    with the lowest score (NULL last).
    """
    if dedupe_reviews:
        one = t.reviews.groupBy("order_id").agg(F.min("review_score").alias("review_score"))
        t = replace(t, reviews=one)
    cols = list(columns) if columns is not None else list(SUMMARY_COLUMNS)
    unknown = set(cols) - set(SUMMARY_COLUMNS)
    if unknown:
        raise ValueError(f"not summary columns: {sorted(unknown)}")
    need = set(cols)

    items = _items(t, need)
    keyed = items.filter(F.col("order_id").isNotNull())
    side = order_side(t, need)
    # Compared as one-element arrays: the union's own partitioning by order_id
    # does not serve that key, so both inputs are shuffled for this join and
    # adaptive execution can split a hot order, whatever the session's settings.
    key = F.array("order_id")
    side = side.withColumn("_key", key).drop("order_id")
    keyed_by = keyed.withColumn("_key", key)
    matched = keyed_by.join(side, "_key", "inner").drop("_key")
    known = order_side_keys(t, need).select(key.alias("_key"))
    unmatched = keyed_by.join(known, "_key", "left_anti").drop("_key")
    no_key = items.filter(F.col("order_id").isNull())
    fact = matched.unionByName(unmatched, allowMissingColumns=True).unionByName(
        no_key, allowMissingColumns=True
    )
    fact = join_dimensions(t, fact, need)
    return fact.select(*cols)
