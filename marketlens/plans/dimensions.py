"""Dimension lookups attached after aggregation (eager aggregation).

Product and seller attributes are functions of their keys (primary keys),
so a report that groups by category or seller place can first aggregate the
item-grain fact by ``product_id`` / ``seller_id`` (partial aggregation,
combined map-side) and attach the attributes to those few rows. The fact
is then never re-shuffled on a dimension key: when a dimension is too
large to broadcast, only the aggregated rows meet it in a shuffle join.
Missing keys (NULL ids, ids absent from the dimension) get NULL attributes,
exactly as the item-level left join gives them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.tables import MarketTables


@dataclass(frozen=True)
class Dimensions:
    products: DataFrame  # product_id, product_category, product_weight_g
    sellers: DataFrame  # seller_id, seller_city, seller_state

    @staticmethod
    def of(t: MarketTables) -> Dimensions:
        return Dimensions(
            products=t.products.select(
                "product_id",
                F.col("product_category_name").alias("product_category"),
                "product_weight_g",
            ),
            sellers=t.sellers.select("seller_id", "seller_city", "seller_state"),
        )

    def attach(self, df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
        """Left-join ``cols`` of the dimension keyed by ``key`` onto ``df``."""
        dim = {"product_id": self.products, "seller_id": self.sellers}[key]
        return df.join(dim.select(key, *cols), key, "left")
