"""Customer growth and transaction reports (purchase-date years).

"Orders" and "transactions" here are summary rows (item x review), as in
the original analysis: a customer with one two-item order is a repeat
customer. Rows are counted as the weight sum of the fact, which for these
reports has one row per order (``fact.order_grain``). ``grain="order"`` counts
orders instead.

Every report reads one aggregate of the fact, ``activity``: per (customer,
purchase date) the summary rows, the orders and the review scores, in one
struct. An order has one customer and one date, so whatever is asked per
order, per customer or per day adds up from it. All parts read the same
struct and filter on its row count, so Catalyst plans one identical
aggregate for all of them and the fact is joined once per report; the parts
re-read only that aggregate, which a hot customer reduces to one row per day.
Customers are counted by ``customer_unique_id``; NULL ids form one group
where rows are grouped but are skipped where ids are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import month_of, percent_half_up, ratio_half_up, year_of
from marketlens.operators import (
    first_event,
    mode_value,
    report_join,
    successor_gap_parts,
    two_level_avg,
)
from marketlens.params import ReportParams
from marketlens.plans.fact import SCORE_N, SCORE_SUM, WEIGHT

GROWTH_COLS = ("purchase_date", "customer_unique_id", "order_id")
TRANSACTION_COLS = ("purchase_date", "customer_unique_id", "order_id", "review_score")


def activity(s: DataFrame) -> DataFrame:
    """Per (customer, purchase date) the struct ``m``: summary ``rows`` and, of a
    fact that carries order ids or review scores, ``orders`` and ``score_sum``,
    ``score_n``. A key the fact does not carry is left out.

    Two partial aggregations; the first does nothing to a fact that has one
    row per order, whose join leaves it partitioned by the order.
    """
    keys = [c for c in ("customer_unique_id", "purchase_date") if c in s.columns]
    scores = [c for c in (SCORE_SUM, SCORE_N) if c in s.columns]
    measures = [F.sum(WEIGHT).alias("rows")] + [F.sum(c).alias(c) for c in scores]
    if "order_id" in s.columns:
        s = s.groupBy("order_id", *keys).agg(
            F.sum(WEIGHT).alias(WEIGHT), *[F.sum(c).alias(c) for c in scores]
        )
        measures.append(F.count(F.lit(1)).alias("orders"))
    return s.groupBy(*keys).agg(F.struct(*measures).alias("m")).filter(F.col("m.rows") > 0)


def transactions(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Transactions ``n`` per (customer, purchase date), by the grain."""
    n = "m.orders" if p is not None and p.grain == "order" else "m.rows"
    return activity(s).select("customer_unique_id", "purchase_date", F.col(n).alias("n"))


def active(s: DataFrame) -> DataFrame:
    """(customer, purchase date) pairs with at least one summary row."""
    return activity(s).select("customer_unique_id", "purchase_date")


def _year(s: DataFrame) -> DataFrame:
    return s.withColumn("date_year", year_of("purchase_date"))


def _year_month(s: DataFrame) -> DataFrame:
    return _year(s).withColumn("date_month", month_of("purchase_date"))


def monthly_active(s: DataFrame) -> DataFrame:
    """Distinct customers per (year, month)."""
    return (
        _year_month(active(s))
        .groupBy("date_year", "date_month")
        .agg(F.countDistinct("customer_unique_id").alias("total_customer"))
    )


def avg_monthly_customer(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Mean of monthly distinct customers per year (months present only)."""
    return two_level_avg(
        _year_month(active(s)),
        ["date_year"],
        ["date_month"],
        "avg_monthly_customer",
        2,
        inner_agg=F.countDistinct("customer_unique_id"),
    )


def _first_orders(s: DataFrame) -> DataFrame:
    # Each customer's earliest purchase date (the NULL id is one customer).
    return first_event(active(s), "customer_unique_id", "purchase_date")


def new_customer(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Customers whose first purchase falls in the year."""
    return (
        _year(_first_orders(s))
        .groupBy("date_year")
        .agg(F.count("customer_unique_id").alias("new_customer"))
    )


def _per_customer_year(s: DataFrame, p: ReportParams | None) -> DataFrame:
    return _year(transactions(s, p)).groupBy("date_year", "customer_unique_id").agg(
        F.sum("n").alias("total_order")
    )


def repeat_order_cust(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Customers with more than one transaction in the year."""
    return (
        _per_customer_year(s, p)
        .filter(F.col("total_order") > 1)
        .groupBy("date_year")
        .agg(F.count("customer_unique_id").alias("repeat_order_cust"))
    )


def avg_order(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Mean transactions per customer and year, 3 decimals."""
    return two_level_avg(
        _year(transactions(s, p)),
        ["date_year"],
        ["customer_unique_id"],
        "avg_order",
        3,
        inner_agg=F.sum("n"),
    )


def yearly_customer(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    joined = report_join(
        avg_monthly_customer(s), [new_customer(s), repeat_order_cust(s, p), avg_order(s, p)]
    )
    return joined.select(
        "date_year", "avg_monthly_customer", "new_customer", "repeat_order_cust", "avg_order"
    )


def monthly_customer(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """New, returning and total customers per month, in calendar order."""
    new = (
        _year_month(_first_orders(s))
        .groupBy("date_year", "date_month")
        .agg(F.count("customer_unique_id").alias("new_customer"))
    )
    joined = report_join(monthly_active(s), [new], on=["date_year", "date_month"])
    new_or_zero = F.coalesce(F.col("new_customer"), F.lit(0).cast("long"))
    return joined.select(
        "date_year",
        "date_month",
        new_or_zero.alias("new_customer"),
        (F.col("total_customer") - new_or_zero).alias("old_customer"),
        "total_customer",
    ).orderBy("date_year", "date_month")


def day_diff(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Mean of ``|next purchase - purchase - 1|`` per year of the earlier one.

    Each customer's transactions are taken in purchase-date order; only years
    with at least one successor appear.
    """
    parts = successor_gap_parts(transactions(s, p), "customer_unique_id", "purchase_date", "n")
    sums = (
        _year(parts)
        .groupBy("date_year")
        .agg(F.sum("tau_sum").alias("_num"), F.sum("tau_n").alias("_den"))
    )
    return sums.filter(F.col("_den") > 0).select(
        "date_year", ratio_half_up("_num", "_den", 2).alias("day_diff")
    )


def yearly_stats(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    per = _per_customer_year(s, p)
    n = F.count(F.lit(1))
    ones = F.sum(F.when(F.col("total_order") == 1, 1).otherwise(0))
    return per.groupBy("date_year").agg(
        F.max("total_order").alias("highest_transaction_by_user"),
        ratio_half_up(F.sum("total_order"), n, 2).alias("avg_total_transaction"),
        percent_half_up(ones, n, 2).alias("percentage_1transaction"),
    )


def mode_of_transaction(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Most common number of transactions per customer, per year (smallest on ties)."""
    return mode_value(_per_customer_year(s, p), "date_year", "total_order", "mode_of_transaction")


def avg_unique_items(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Mean summary rows per order and year (review fan-out included)."""
    return _year(activity(s)).groupBy("date_year").agg(
        ratio_half_up(F.sum("m.rows"), F.sum("m.orders"), 2).alias("avg_unique_items_each_transaction")
    )


def avg_rating(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    """Mean review score per year, item-weighted; NULL scores skipped."""
    return _year(activity(s)).groupBy("date_year").agg(
        ratio_half_up(F.sum(f"m.{SCORE_SUM}"), F.sum(f"m.{SCORE_N}"), 2).alias("avg_rating")
    )


def yearly_transaction(s: DataFrame, p: ReportParams | None = None) -> DataFrame:
    joined = report_join(
        yearly_stats(s, p), [day_diff(s, p), avg_unique_items(s), avg_rating(s)]
    )
    return joined.select(
        "date_year",
        "day_diff",
        "highest_transaction_by_user",
        "avg_total_transaction",
        "percentage_1transaction",
        "avg_unique_items_each_transaction",
        "avg_rating",
    )
