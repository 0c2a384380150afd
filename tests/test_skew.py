"""A hot order (a large share of items and of reviews) is split across tasks."""

from __future__ import annotations

import contextlib
import dataclasses

from helpers import D, item, make_tables, order
from marketlens.plans import build_summary

# Default settings but for thresholds small enough for a fixture: the plans
# must be safe by their own shape, without the library's scale settings.
SKEW_CONF = {
    "spark.sql.unionOutputPartitioning": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512",
    "spark.sql.shuffle.partitions": "16",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def executed_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_order_join_is_split(spark):
    others = [f"o{i}" for i in range(60)]
    t = make_tables(
        spark,
        customers=[("c1", "u1", "x", "s")],
        orders=[order("hot", "c1", purchase=D(2017, 1, 1))] + [order(o, "c1") for o in others],
        items=[item("hot", n) for n in range(3000)] + [item(o) for o in others] + [item("lost")],
        reviews=[("hot", 1 + n % 5) for n in range(40)] + [(o, 3) for o in others],
    )
    t = dataclasses.replace(t, items=t.items.repartition(12))
    with conf(spark, SKEW_CONF):
        df = build_summary(t, ["order_id", "review_score", "purchase_date"])
        rows = df.collect()
        plan = executed_plan(df)
    assert len(rows) == 3000 * 40 + 60 + 1
    assert sum(1 for r in rows if r.order_id == "lost" and r.purchase_date is None) == 1
    assert "skew=true" in plan


def test_hot_order_in_weighted_fact_is_split(spark):
    from marketlens.plans.fact import build_fact

    others = [f"o{i}" for i in range(60)]
    t = make_tables(
        spark,
        customers=[("c1", "u1", "x", "s")],
        orders=[order("hot", "c1")] + [order(o, "c1") for o in others],
        items=[item("hot", n) for n in range(3000)] + [item(o) for o in others],
        reviews=[("hot", 1 + n % 5) for n in range(500)] + [(o, 3) for o in others],
    )
    with conf(spark, SKEW_CONF):
        df = build_fact(t, ["order_id", "order_item_id", "purchase_date", "review_score"])
        rows = df.collect()
        plan = executed_plan(df)
    # one row per item; the hot order's 500 reviews became a weight
    assert len(rows) == 3060
    hot = [r for r in rows if r.order_id == "hot"]
    assert {r.w for r in hot} == {500} and {r.score_n for r in hot} == {500}
    assert "skew=true" in plan


def test_hot_customer_is_split(spark):
    from marketlens.plans.fact import build_fact

    orders = [order(f"h{i}", "hotc") for i in range(2000)] + [order(f"o{i}", f"c{i}") for i in range(60)]
    t = make_tables(
        spark,
        customers=[("hotc", "uh", "x", "s")] + [(f"c{i}", f"u{i}", "y", "s") for i in range(60)],
        orders=orders,
        items=[item(o[0]) for o in orders],
    )
    with conf(spark, SKEW_CONF):
        df = build_fact(t, ["order_id", "customer_unique_id", "customer_city"])
        rows = df.collect()
        plan = executed_plan(df)
    assert len(rows) == 2060
    assert sum(1 for r in rows if r.customer_unique_id == "uh") == 2000
    assert "skew=true" in plan


def test_hot_order_in_payments_is_split(spark):
    from marketlens.params import ReportParams
    from marketlens.plans import payments

    orders = [order("hot", "c1", est=D(2017, 5, 1))] + [order(f"o{i}", "c1", est=D(2016, 5, 1)) for i in range(60)]
    pays = [("hot", n, "credit_card", 1, 1.0) for n in range(3000)]
    pays += [(f"o{i}", 1, "boleto", 1, 1.0) for i in range(60)]
    t = make_tables(spark, orders=orders, payments=pays)
    with conf(spark, SKEW_CONF):
        df = payments.payment_dates(t, ReportParams())
        n = len(df.collect())
        plan = executed_plan(df)
        summary = {r.payment_type: r for r in payments.payment_summary(t, ReportParams()).collect()}
    assert n == 3060
    assert summary["credit_card"]["2017"] == 3000 and summary["boleto"]["2016"] == 60
    assert "skew=true" in plan
