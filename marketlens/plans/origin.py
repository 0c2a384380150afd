"""Where customers and sellers come from.

``origin`` mixes two year bases on purpose, as the original analysis does:
distinct-place totals and home-place shares by estimated-delivery year,
top places by purchase year. The base table (delivery years) decides which
years appear; tied top places multiply rows.

All parts but the sellers' top city read one aggregate that serves both
bases, ``place_rows``: summary rows per (delivery year, purchase year, city,
state). The fact is joined for it once.

Customer places come with the order (joined at order grain). Seller places
are attached after aggregating by (years, seller), a few rows per seller. The
sellers' top city counts distinct (order, date, city): almost every item is
its own (order, seller), so nothing is gained by aggregating first; the rows
(order, date, seller) meet the seller table as they are (broadcast if its
measured size allows, else a join whose hot sellers adaptive execution splits)
and are made distinct once, with the city.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import percent_half_up, year_of
from marketlens.operators import distinct_counts, report_join, share_topn_others, top_k_per_group
from marketlens.params import ReportParams
from marketlens.plans.dimensions import Dimensions
from marketlens.plans.fact import WEIGHT

SIDES = {
    "customer": {
        "id": "customer_unique_id",
        "city": "customer_city",
        "state": "customer_state",
        "city_grain": "row",
        "out_state": "highest_customer_state",
        "out_city": "highest_customer_city",
    },
    "seller": {
        "id": "seller_id",
        "city": "seller_city",
        "state": "seller_state",
        # Seller top city counts distinct (order, purchase date, city).
        "city_grain": "order",
        "out_state": "highest_state",
        "out_city": "highest_city",
    },
}


def _deferred(side: str) -> bool:
    """Seller places are looked up after aggregating by seller id."""
    return side == "seller"


def origin_cols(side: str) -> tuple[str, ...]:
    d = SIDES[side]
    places = ["seller_id"] if _deferred(side) else [d["city"], d["state"]]
    return ("purchase_date", "est_delivery_date", *places)


def order_cols(side: str) -> tuple[str, ...]:
    """Columns of a top city that counts distinct orders; none if it counts rows."""
    if SIDES[side]["city_grain"] != "order":
        return ()
    return ("order_id", "purchase_date", "seller_id" if _deferred(side) else SIDES[side]["city"])


def share_cols(side: str) -> tuple[str, ...]:
    d = SIDES[side]
    return ("seller_id",) if _deferred(side) else (d["id"], d["city"], d["state"])


def place_rows(s: DataFrame, side: str, dims: Dimensions | None) -> DataFrame:
    """Summary rows ``n`` per (``est_year``, ``purchase_year``, city, state)."""
    d = SIDES[side]
    years = ["est_year", "purchase_year"]
    keyed = s.withColumn("est_year", year_of("est_delivery_date")).withColumn(
        "purchase_year", year_of("purchase_date")
    )
    if _deferred(side):
        per_seller = keyed.groupBy(*years, "seller_id").agg(F.sum(WEIGHT).alias(WEIGHT))
        keyed = dims.attach(per_seller, "seller_id", [d["city"], d["state"]])
    rows = keyed.groupBy(*years, d["city"], d["state"]).agg(F.sum(WEIGHT).alias("n"))
    # Always true; every part reads the count, so all read the same aggregate.
    return rows.filter(F.col("n") > 0)


def total_city_state(s: DataFrame, side: str, dims: Dimensions | None = None) -> DataFrame:
    d = SIDES[side]
    rows = place_rows(s, side, dims).withColumnRenamed("est_year", "date_year")
    return distinct_counts(
        rows, ["date_year"], {"total_city": d["city"], "total_state": d["state"]}, rows=F.col("n")
    )


def _top_place(counts: DataFrame, count_name: str) -> DataFrame:
    return top_k_per_group(counts, ["date_year"], count_name, 1)


def highest_state(s: DataFrame, side: str, dims: Dimensions | None = None) -> DataFrame:
    name = "total_transaction_in_state"
    counts = (
        place_rows(s, side, dims)
        .groupBy(F.col("purchase_year").alias("date_year"), F.col(SIDES[side]["state"]).alias("highest_state"))
        .agg(F.sum("n").alias(name))
    )
    return _top_place(counts, name)


def highest_city(s: DataFrame, side: str, dims: Dimensions | None = None) -> DataFrame:
    d = SIDES[side]
    name = "total_transaction_in_city"
    if d["city_grain"] == "order":
        # distinct (order, purchase date, city): every tuple counts once
        rows = s.select("order_id", "purchase_date", "seller_id" if _deferred(side) else d["city"])
        if _deferred(side):
            rows = dims.attach(rows, "seller_id", [d["city"]])
        tuples = rows.select("order_id", "purchase_date", d["city"]).distinct()
        counts = tuples.groupBy(
            year_of("purchase_date").alias("date_year"), F.col(d["city"]).alias("highest_city")
        ).agg(F.count(F.lit(1)).alias(name))
    else:
        counts = (
            place_rows(s, side, dims)
            .groupBy(F.col("purchase_year").alias("date_year"), F.col(d["city"]).alias("highest_city"))
            .agg(F.sum("n").alias(name))
        )
    return _top_place(counts, name)


def home_share(
    s: DataFrame, side: str, p: ReportParams, dims: Dimensions | None = None
) -> DataFrame:
    d = SIDES[side]
    rows = place_rows(s, side, dims)
    n = F.sum("n")

    def share(col: str, value: str):
        hits = F.sum(F.when(F.col(col) == value, F.col("n")).otherwise(0))
        return percent_half_up(hits, n, 2)

    return rows.groupBy(F.col("est_year").alias("date_year")).agg(
        n.alias("total_transaction"),
        share(d["state"], p.home_state).alias("state_percentage_from_total"),
        share(d["city"], p.home_city).alias("city_percentage_from_total"),
    )


def origin(
    s: DataFrame,
    side: str,
    p: ReportParams,
    dims: Dimensions | None = None,
    values: DataFrame | None = None,
) -> DataFrame:
    """``values``: the fact without weights, for the part that counts distinct orders."""
    d = SIDES[side]
    by_order = d["city_grain"] == "order" and values is not None
    joined = report_join(
        total_city_state(s, side, dims),
        [
            highest_state(s, side, dims).drop("yearly_rank"),
            highest_city(values if by_order else s, side, dims).drop("yearly_rank"),
            home_share(s, side, p, dims).drop("total_transaction"),
        ],
    )
    return joined.select(
        "date_year",
        "total_state",
        F.col("highest_state").alias(d["out_state"]),
        "total_transaction_in_state",
        "state_percentage_from_total",
        "total_city",
        F.col("highest_city").alias(d["out_city"]),
        "total_transaction_in_city",
        "city_percentage_from_total",
    )


def origin_share(
    s: DataFrame,
    side: str,
    level: str,
    dp: int,
    count_name: str,
    p: ReportParams,
    dims: Dimensions | None = None,
) -> DataFrame:
    """Top-n places by share of distinct (id, city, state), rest as others."""
    d = SIDES[side]
    entities = s
    if _deferred(side):
        ids = s.select("seller_id").distinct()
        entities = dims.attach(ids, "seller_id", [d["city"], d["state"]])
    return share_topn_others(
        entities,
        [d["id"], d["city"], d["state"]],
        d[level],
        dp,
        count_name,
        n=p.top_n,
        other=p.others_label,
    )
