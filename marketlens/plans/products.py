"""Product category quality reports.

Years come from three different dates, as in the original analysis:
revenue and re-orders by estimated delivery year, cancellations by approval
year, transaction counts by purchase year. Ranks are RANK (ties kept) and a
NULL revenue ranks first.

Categories are attached after aggregating by product (``Dimensions``): the
fact is aggregated per (year, product) map-side and only those rows meet
the product table. The one exception is the re-order ranking of categories,
where such an aggregate would hardly reduce anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import year_of
from marketlens.operators import report_join, reorder_top_k, top_k_per_group, zip_by_position
from marketlens.params import ReportParams
from marketlens.plans.dimensions import Dimensions
from marketlens.plans.fact import WEIGHT

REVENUE_COLS = ("order_status", "est_delivery_date", "product_id", "total_cost")
CANCEL_COLS = ("order_status", "approved_date", "product_id")
PRODUCT_SUMMARY_COLS = tuple(dict.fromkeys(REVENUE_COLS + CANCEL_COLS))
REORDER_PRODUCT_COLS = ("order_status", "est_delivery_date", "customer_unique_id", "product_id")
REORDER_CATEGORY_COLS = REORDER_PRODUCT_COLS
TRANSACTION_COLS = ("purchase_date", "product_id")
TOP_SUMMARY_COLS = tuple(
    dict.fromkeys(REORDER_PRODUCT_COLS + REVENUE_COLS + TRANSACTION_COLS)
)


def _rows():
    return F.sum(WEIGHT)


def _revenue():
    return F.sum(F.col("total_cost") * F.col(WEIGHT))


def _delivered(s: DataFrame, p: ReportParams) -> DataFrame:
    return s.filter(F.col("order_status") == p.delivered)


def _canceled(s: DataFrame, p: ReportParams) -> DataFrame:
    return s.filter(F.col("order_status") == p.canceled)


def _by_category(per_product: DataFrame, d: Dimensions, keys: list[str], measure: str) -> DataFrame:
    """Attach categories to per-product aggregates and re-aggregate."""
    return (
        d.attach(per_product, "product_id", ["product_category"])
        .groupBy(*keys, "product_category")
        .agg(F.sum(measure).alias(measure))
    )


def _revenue_by_product(s: DataFrame, p: ReportParams) -> DataFrame:
    """Delivered revenue per (estimated-delivery year, product)."""
    return (
        _delivered(s, p)
        .groupBy(year_of("est_delivery_date").alias("date_year"), "product_id")
        .agg(_revenue().alias("revenue"))
    )


def _cancels_by_product(s: DataFrame, p: ReportParams) -> DataFrame:
    """Cancelled summary rows per (approval year, product)."""
    return (
        _canceled(s, p)
        .groupBy(year_of("approved_date").alias("date_year"), "product_id")
        .agg(_rows().alias("total_cancel"))
    )


def _both_by_product(s: DataFrame, p: ReportParams) -> tuple[DataFrame, DataFrame]:
    """``_revenue_by_product`` and ``_cancels_by_product`` from one aggregate.

    Per (estimated-delivery year, approval year, product): delivered revenue
    and rows, cancelled rows. The measures travel together in one struct and
    each branch selects by a condition on the aggregated values, so both
    read the same aggregate -- one pass over the fact -- instead of one
    filtered copy per status.
    """
    delivered = F.col("order_status") == p.delivered
    canceled = F.col("order_status") == p.canceled
    m = s.groupBy(
        year_of("est_delivery_date").alias("est_year"),
        year_of("approved_date").alias("approved_year"),
        "product_id",
    ).agg(
        F.struct(
            F.sum(F.when(delivered, F.col("total_cost") * F.col(WEIGHT))).alias("revenue"),
            F.sum(F.when(delivered, F.col(WEIGHT))).alias("delivered"),
            F.sum(F.when(canceled, F.col(WEIGHT))).alias("canceled"),
        ).alias("m")
    )
    revenue = (
        m.filter(F.col("m.delivered") > 0)
        .groupBy(F.col("est_year").alias("date_year"), "product_id")
        .agg(F.sum("m.revenue").alias("revenue"))
    )
    cancels = (
        m.filter(F.col("m.canceled") > 0)
        .groupBy(F.col("approved_year").alias("date_year"), "product_id")
        .agg(F.sum("m.canceled").alias("total_cancel"))
    )
    return revenue, cancels


# The four parts of the product summary, of the per-product rows: those of
# one status, or both from the shared aggregate.


def _yearly(per_product: DataFrame, measure: str) -> DataFrame:
    return per_product.groupBy("date_year").agg(F.sum(measure).alias(measure))


def _top_category(per_product: DataFrame, d: Dimensions, measure: str, name: str) -> DataFrame:
    by_category = _by_category(per_product, d, ["date_year"], measure)
    top = top_k_per_group(by_category, ["date_year"], measure, 1)
    return top.select("date_year", F.col("product_category").alias(name))


def yearly_revenue(s: DataFrame, p: ReportParams, d: Dimensions | None = None) -> DataFrame:
    """Delivered revenue per estimated-delivery year (exact decimal sum)."""
    return _yearly(_revenue_by_product(s, p), "revenue")


def yearly_cancel(s: DataFrame, p: ReportParams, d: Dimensions | None = None) -> DataFrame:
    """Cancelled summary rows per approval year (NULL approval is a NULL year)."""
    return _yearly(_cancels_by_product(s, p), "total_cancel")


def top_product(s: DataFrame, p: ReportParams, d: Dimensions) -> DataFrame:
    """Category with the highest delivered revenue per year (all ties)."""
    return _top_category(_revenue_by_product(s, p), d, "revenue", "top_product")


def top_cancel(s: DataFrame, p: ReportParams, d: Dimensions) -> DataFrame:
    """Category with the most cancelled rows per approval year (all ties)."""
    return _top_category(_cancels_by_product(s, p), d, "total_cancel", "most_canceled")


def product_summary(s: DataFrame, p: ReportParams, d: Dimensions) -> DataFrame:
    """Revenue, cancellations and top categories; years with revenue only."""
    revenue, cancels = _both_by_product(s, p)
    joined = report_join(
        _yearly(revenue, "revenue"),
        [
            _yearly(cancels, "total_cancel"),
            _top_category(revenue, d, "revenue", "top_product"),
            _top_category(cancels, d, "total_cancel", "most_canceled"),
        ],
    )
    return joined.select(
        "date_year",
        F.col("revenue").cast("double").alias("revenue"),
        "total_cancel",
        "top_product",
        "most_canceled",
    )


def _per_customer_product(s: DataFrame, p: ReportParams) -> DataFrame:
    """Delivered summary rows per (year, customer, product)."""
    return (
        _delivered(s, p)
        .groupBy(
            year_of("est_delivery_date").alias("date_year"), "customer_unique_id", "product_id"
        )
        .agg(_rows().alias("_n"))
    )


def top_reorder_product(s: DataFrame, p: ReportParams, d: Dimensions, k: int = 3) -> DataFrame:
    # A product has one category, so ranking (year, product) and attaching
    # the category to the ranked rows equals grouping by (year, category,
    # product); only the top rows meet the product table.
    ranked = reorder_top_k(
        _per_customer_product(s, p),
        "date_year",
        "customer_unique_id",
        ["product_id"],
        k,
        weight="_n",
    )
    return d.attach(ranked, "product_id", ["product_category"]).select(
        "date_year",
        "product_category",
        F.col("product_id").alias("top_product_id"),
        "total_reorder",
        "yearly_rank",
    )


def top_reorder_category(s: DataFrame, p: ReportParams, d: Dimensions, k: int = 3) -> DataFrame:
    # Few customers buy a product twice: counting per (customer, product) first
    # would shuffle every item once more for nothing. The item rows meet the
    # product table as they are and are counted once, with the category.
    rows = _delivered(s, p).select(
        year_of("est_delivery_date").alias("date_year"), "customer_unique_id", "product_id", WEIGHT
    )
    ranked = reorder_top_k(
        d.attach(rows, "product_id", ["product_category"]),
        "date_year",
        "customer_unique_id",
        ["product_category"],
        k,
        weight=WEIGHT,
    )
    return ranked.select(
        "date_year",
        F.col("product_category").alias("top_reorder_category"),
        "total_reorder",
        "yearly_rank",
    )


def top_category_revenue(s: DataFrame, p: ReportParams, d: Dimensions, k: int = 3) -> DataFrame:
    by_category = _by_category(_revenue_by_product(s, p), d, ["date_year"], "revenue")
    top = top_k_per_group(by_category, ["date_year"], "revenue", k)
    return top.select(
        "date_year",
        F.col("product_category").alias("top_category_revenue"),
        F.col("revenue").cast("double").alias("revenue"),
        "yearly_rank",
    )


def top_transaction_category(
    s: DataFrame, p: ReportParams, d: Dimensions, k: int = 3
) -> DataFrame:
    per_product = s.groupBy(
        year_of("purchase_date").alias("purchase_year"), "product_id"
    ).agg(_rows().alias("count"))
    counts = _by_category(per_product, d, ["purchase_year"], "count")
    top = top_k_per_group(counts, ["purchase_year"], "count", k)
    return top.select("purchase_year", "product_category", "count", "yearly_rank")


def top_summary(s: DataFrame, p: ReportParams, d: Dimensions, k: int = 3) -> DataFrame:
    """Line-by-line zip of the four top-k tables."""
    return zip_top_tables(
        top_reorder_category(s, p, d, k),
        top_reorder_product(s, p, d, k),
        top_category_revenue(s, p, d, k),
        top_transaction_category(s, p, d, k),
    )


def zip_top_tables(cat: DataFrame, prod: DataFrame, rev: DataFrame, trx: DataFrame) -> DataFrame:
    """``top_summary`` of the four (stored) top-k tables.

    Each table is numbered in (year, rank, name[, product]) order, NULLs
    last, and the four are inner-joined on that number: the result is as
    long as the shortest table, and one line may mix different years.
    """
    parts = [
        (
            cat.select(
                "date_year",
                "top_reorder_category",
                F.col("total_reorder").alias("total_reorder_category"),
                F.col("yearly_rank").alias("reorder_rank"),
            ),
            ["date_year", "reorder_rank", "top_reorder_category"],
        ),
        (
            prod.select(
                F.col("date_year").alias("_y2"),
                F.col("product_category").alias("top_reorder_product_category"),
                "top_product_id",
                "total_reorder",
                F.col("yearly_rank").alias("reorder_product_rank"),
            ),
            ["_y2", "reorder_product_rank", "top_reorder_product_category", "top_product_id"],
        ),
        (
            rev.select(
                F.col("date_year").alias("_y3"),
                "top_category_revenue",
                "revenue",
                F.col("yearly_rank").alias("revenue_rank"),
            ),
            ["_y3", "revenue_rank", "top_category_revenue"],
        ),
        (
            trx.select(
                F.col("purchase_year").alias("_y4"),
                F.col("product_category").alias("top_transaction_category"),
                F.col("count").alias("total_transaction"),
                F.col("yearly_rank").alias("transaction_rank"),
            ),
            ["_y4", "transaction_rank", "top_transaction_category"],
        ),
    ]
    zipped = zip_by_position(parts, "rn")
    return zipped.select(
        "rn",
        "date_year",
        "top_reorder_category",
        "total_reorder_category",
        "reorder_rank",
        "top_reorder_product_category",
        "top_product_id",
        "total_reorder",
        "reorder_product_rank",
        "top_category_revenue",
        "revenue",
        "revenue_rank",
        "top_transaction_category",
        "total_transaction",
        "transaction_rank",
    )
