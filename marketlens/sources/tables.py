"""The bundle of base tables every report reads from."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class MarketTables:
    """Base tables of the marketplace, column names as in ``schemas``."""

    orders: DataFrame
    customers: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    geolocation: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` under their export names."""
        names = {
            "orders": "orders_dataset",
            "customers": "customers_dataset",
            "items": "order_items_dataset",
            "payments": "order_payments_dataset",
            "reviews": "order_reviews_dataset",
            "products": "product_dataset",
            "sellers": "sellers_dataset",
            "geolocation": "geolocation_dataset",
        }
        for attr, view in names.items():
            getattr(self, attr).createOrReplaceTempView(prefix + view)
