"""The item-grain weighted fact the reports run on.

The summary view repeats every item once per review of its order. Reports
never need those copies, only how many rows each item stands for and the
review scores they carry. So reviews are aggregated per order first
(combined map-side: a hot review group collapses to one row per task) and
every item carries

* ``w`` = max(1, reviews of its order): the number of summary rows it is;
* ``score_sum`` / ``score_n``: the sum and count of its order's non-NULL
  review scores (only when ``review_score`` is asked for).

A report over the summary then reads ``count(*)`` as ``sum(w)``,
``sum(x)`` as ``sum(x * w)`` and ``avg(review_score)`` as
``sum(score_sum) / sum(score_n)``; distinct counts, minima and DISTINCT
projections are unchanged. The fact has as many rows as there are items,
not items x reviews.

Plan shape: order attributes (orders with their customer, payment totals)
and review aggregates are combined into one table with exactly one row per
order (full outer joins of unique-key inputs: no hot key possible). The
items then meet it in one left join on ``order_id`` whose inputs are both
shuffles, so adaptive execution can split a hot order on the item side.
Items without an order id skip the join (they cannot match), which keeps
the item shuffle identical in every report part.

Columns of the order alone (``order_grain``: dates, status, customer,
payments, reviews) need no item rows at all: the items are counted per
order, combined map-side so that a hot order is one row per task, and meet
the orders in a join of two unique keys. Such a fact has one row per order,
weighted by its items times its reviews; sums of weights and scores are
those of the item-grain fact. The customer reports all run on it.
 Product and seller
attributes can be requested here (item-level join, used by the
fingerprint and the stored fact), but the reports attach them after
aggregating (``plans.dimensions``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.plans.summary import (
    CUSTOMER_COLS,
    ORDER_COLS,
    PAYMENT_COLS,
    SUMMARY_COLUMNS,
    _items,
    join_dimensions,
    order_level,
)
from marketlens.sources.tables import MarketTables

WEIGHT = "w"
SCORE_SUM = "score_sum"
SCORE_N = "score_n"
# Columns that differ between the items of an order.
ITEM_COLS = set(SUMMARY_COLUMNS) - ORDER_COLS - CUSTOMER_COLS - PAYMENT_COLS - {"order_id", "review_score"}


def review_stats(t: MarketTables, with_scores: bool) -> DataFrame:
    """Per order: number of reviews (and score sum / count)."""
    aggs = [F.count(F.lit(1)).alias("_reviews")]
    if with_scores:
        aggs += [
            F.sum("review_score").cast("long").alias(SCORE_SUM),
            F.count("review_score").alias(SCORE_N),
        ]
    return (
        t.reviews.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(*aggs)
    )


def order_grain(columns: Iterable[str]) -> bool:
    """No column tells the items of an order apart: one row per order will do."""
    return not set(columns) & ITEM_COLS


def build_fact(
    t: MarketTables, columns: Iterable[str] | None = None, weighted: bool = True
) -> DataFrame:
    """Fact with ``columns`` plus ``w`` (and score columns when ``review_score``
    is requested; the column itself is not carried): one row per item, or per
    order if ``columns`` are those of an order (``order_grain``).

    ``weighted=False`` is for readers that only ask which values occur: every
    row weighs 1 and the reviews are not read.
    """
    cols = list(columns) if columns is not None else list(SUMMARY_COLUMNS)
    unknown = set(cols) - set(SUMMARY_COLUMNS)
    if unknown:
        raise ValueError(f"not summary columns: {sorted(unknown)}")
    need = set(cols)
    with_scores = "review_score" in need

    weighted = weighted or with_scores
    side = review_stats(t, with_scores) if weighted else None
    level = order_level(t, need)
    if level is not None:
        level = level.filter(F.col("order_id").isNotNull())
        side = level if side is None else level.join(side, "order_id", "full")
    if order_grain(need):
        # One row per order on both sides; the items without an order id are
        # one row, which matches nothing.
        fact = t.items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_items"))
        if side is not None:
            fact = fact.join(side, "order_id", "left")
        return _weighted(fact, cols, F.col("_items"), weighted, with_scores)

    items = _items(t, need)
    # Items without an order id can never match: they are appended as they
    # are (a pushed-down IS NULL scan, never shuffled). Joining only keyed
    # items keeps the item shuffle identical in every branch of a report,
    # whether or not a filter turns the join into an inner join, so Spark
    # reuses one item shuffle across all parts of a report.
    keyed = items.filter(F.col("order_id").isNotNull())
    fact = keyed if side is None else keyed.join(side, "order_id", "left")
    fact = fact.unionByName(items.filter(F.col("order_id").isNull()), allowMissingColumns=True)
    fact = join_dimensions(t, fact, need)
    return _weighted(fact, cols, F.lit(1).cast("long"), weighted, with_scores)


def _weighted(fact: DataFrame, cols: list[str], items: Column, weighted: bool, with_scores: bool) -> DataFrame:
    """``cols`` and what a row of ``items`` items stands for."""
    weight = F.lit(1).cast("long")
    if weighted:
        weight = items * F.greatest(F.coalesce(F.col("_reviews"), F.lit(0)), F.lit(1)).cast("long")
    out = [c for c in cols if c != "review_score"] + [weight.alias(WEIGHT)]
    if with_scores:
        out += [(items * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in (SCORE_SUM, SCORE_N)]
    return fact.select(*out)


__all__ = ["SCORE_N", "SCORE_SUM", "WEIGHT", "build_fact", "order_grain", "review_stats"]
