"""Derive the eight marketplace tables from TPC-H-like tables.

The test data is a TPC-H-style star schema. This adapter maps it onto the
marketplace model with deterministic formulas (identical in the DuckDB
oracle), so every report runs unchanged on it. The formulas deliberately
create missing and duplicated reviews, split payments, NULL approval dates
and an excluded payment type, so that the reports' NULL and fan-out rules
are exercised.

Every derived table is a projection of one or two scans (plus the 25-row nation /
5-row region lookup), so Catalyst prunes unread columns and pushes filters
into the Parquet scans.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.params import ReportParams
from marketlens.sources.tables import MarketTables

# Fixed values of the adapter: status and priority mappings.
STATUS_MAP = {"F": "delivered", "O": "canceled", "P": "shipped"}
PAYMENT_TYPE_BY_PRIORITY = {
    "1-URGENT": "credit_card",
    "2-HIGH": "boleto",
    "3-MEDIUM": "voucher",
    "4-NOT SPECIFIED": "not_defined",
    "5-LOW": "debit_card",
}
# Columns of the files. Reading with a schema opens no file to ask for it, so
# tables that a report does not touch cost nothing.
COLUMNS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey long, s_nationkey int",
    "part": "p_partkey long, p_type string, p_size int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, "
    "l_extendedprice double, l_quantity double",
}
# Analysis parameters that fit the adapter's places and years.
ADAPTER_PARAMS = ReportParams(
    home_state="ASIA", home_city="NATION_1", payment_years=(1996, 1997, 1998)
)


def _case(col: Column, mapping: dict[str, str]) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, v) if out is None else out.when(col == k, v))
    return out


def _with_place(df: DataFrame, nationkey: str, read) -> DataFrame:
    """Add ``place_city`` (nation name) and ``place_state`` (region name).

    No broadcast hint: Spark broadcasts both lookups where their size allows.
    """
    nation = read("nation").select(
        F.col("n_nationkey").alias("_nk"),
        F.col("n_name").alias("place_city"),
        F.col("n_regionkey").alias("_rk"),
    )
    region = read("region").select(
        F.col("r_regionkey").alias("_rk2"), F.col("r_name").alias("place_state")
    )
    return (
        df.join(nation, F.col(nationkey) == F.col("_nk"), "left")
        .join(region, F.col("_rk") == F.col("_rk2"), "left")
        .drop("_nk", "_rk", "_rk2")
    )


def from_tpch(spark: SparkSession, sf_dir: str) -> MarketTables:
    sf_dir = sf_dir.rstrip("/")

    @cache
    def read(name: str) -> DataFrame:
        return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")

    o = read("orders")
    k = F.col("o_orderkey")
    purchase = F.to_date(F.col("o_orderdate"))

    orders = o.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _case(F.col("o_orderstatus"), STATUS_MAP).alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        F.when(k % 37 != 0, F.date_add(purchase, 1)).alias("order_approved_at"),
        F.date_add(purchase, (F.lit(10) + k % 30).cast("int")).alias(
            "order_estimated_delivery_date"
        ),
    )

    c = read("customer")
    customers = _with_place(c, "c_nationkey", read).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_unique_id"),
        F.col("place_city").alias("customer_city"),
        F.col("place_state").alias("customer_state"),
    )

    s = read("supplier")
    sellers = _with_place(s, "s_nationkey", read).select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("place_city").alias("seller_city"),
        F.col("place_state").alias("seller_state"),
    )

    products = read("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        F.col("p_size").cast("double").alias("product_weight_g"),
    )

    items = read("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.to_date(F.col("l_shipdate")).alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("freight_value"),
    )

    # One review for most orders, none for every 11th, a second one for
    # keys = 1 mod 50: missing and duplicated reviews.
    reviews = o.filter(k % 11 != 0).select(
        k.alias("order_id"), (F.lit(1) + k % 5).cast("int").alias("review_score")
    ).unionByName(
        o.filter(k % 50 == 1).select(
            k.alias("order_id"),
            (F.lit(1) + (k * 3) % 5).cast("int").alias("review_score"),
        )
    )

    payments = o.select(
        k.alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        _case(F.col("o_orderpriority"), PAYMENT_TYPE_BY_PRIORITY).alias("payment_type"),
        (F.lit(1) + k % 12).cast("int").alias("payment_installments"),
        F.col("o_totalprice").alias("payment_value"),
    ).unionByName(
        o.filter(k % 10 == 0).select(
            k.alias("order_id"),
            F.lit(2).alias("payment_sequential"),
            F.lit("voucher").alias("payment_type"),
            F.lit(1).alias("payment_installments"),
            F.lit(1.0).alias("payment_value"),
        )
    )

    geolocation = _with_place(c, "c_nationkey", read).select(
        F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
        (F.col("c_custkey") % 3).cast("double").alias("geolocation_lat"),
        (-(F.col("c_custkey") % 3)).cast("double").alias("geolocation_lng"),
        F.col("c_mktsegment").alias("geolocation_city"),
        F.col("place_state").alias("geolocation_state"),
    )

    return MarketTables(
        orders=orders,
        customers=customers,
        items=items,
        payments=payments,
        reviews=reviews,
        products=products,
        sellers=sellers,
        geolocation=geolocation,
    )
