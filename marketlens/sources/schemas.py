"""Schemas of the eight marketplace base tables.

Only columns the reports read. Ids are strings in marketplace exports;
dates arrive as timestamps or text and are cast to DATE at the source
(day arithmetic in the reports needs whole days).
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, DT = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ORDERS = _schema(
    ("order_id", S),
    ("customer_id", S),
    ("order_status", S),
    ("order_purchase_timestamp", DT),
    ("order_approved_at", DT),
    ("order_estimated_delivery_date", DT),
)
CUSTOMERS = _schema(
    ("customer_id", S),
    ("customer_unique_id", S),
    ("customer_city", S),
    ("customer_state", S),
)
ORDER_ITEMS = _schema(
    ("order_id", S),
    ("order_item_id", I),
    ("product_id", S),
    ("seller_id", S),
    ("shipping_limit_date", DT),
    ("price", D),
    ("freight_value", D),
)
PAYMENTS = _schema(
    ("order_id", S),
    ("payment_sequential", I),
    ("payment_type", S),
    ("payment_installments", I),
    ("payment_value", D),
)
REVIEWS = _schema(("order_id", S), ("review_score", I))
PRODUCTS = _schema(
    ("product_id", S),
    ("product_category_name", S),
    ("product_weight_g", D),
)
SELLERS = _schema(("seller_id", S), ("seller_city", S), ("seller_state", S))
GEOLOCATION = _schema(
    ("geolocation_zip_code_prefix", S),
    ("geolocation_lat", D),
    ("geolocation_lng", D),
    ("geolocation_city", S),
    ("geolocation_state", S),
)

# File stem of each table in a marketplace export -> schema.
TABLES: dict[str, T.StructType] = {
    "orders_dataset": ORDERS,
    "customers_dataset": CUSTOMERS,
    "order_items_dataset": ORDER_ITEMS,
    "order_payments_dataset": PAYMENTS,
    "order_reviews_dataset": REVIEWS,
    "product_dataset": PRODUCTS,
    "sellers_dataset": SELLERS,
    "geolocation_dataset": GEOLOCATION,
}
