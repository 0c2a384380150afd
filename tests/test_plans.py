"""Plan shape: the physical plans we want at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from helpers import below, kind_of, plan_nodes, reads, rows_out
from marketlens.plans import Workload, all_reports, customers
from marketlens.sources import ADAPTER_PARAMS, from_tpch

SF_DIR = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan_text(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def plans(spark):
    qs = E.queries()
    names = [n for n in qs if not n.startswith("op") or not n[2].isdigit()]
    return {n: plan_text(qs[n](spark, SF_DIR)) for n in names if n != "pipeline"}


def test_no_python_in_any_plan(plans):
    for name, text in plans.items():
        assert not any(p in text for p in PYTHON_NODES), name


def test_top_k_is_group_limited(plans):
    for name in ("top_category_revenue", "top_reorder_product", "top_transaction_category"):
        assert "WindowGroupLimit" in plans[name], name


def test_share_reports_use_no_global_window(plans):
    # rank <= 5 over all places is a top-5 threshold subquery, never a
    # window over every place in one task
    for name in ("origin_customer_city", "origin_customer_state", "origin_seller_city"):
        text = plans[name]
        assert "Window" not in text, name
        assert "TakeOrderedAndProject" in text, name


def test_day_diff_window_sees_per_day_aggregate(plans):
    tree = plans["yearly_transaction__day_diff"].split("\n\n")[0]
    lines = tree.splitlines()
    w = next(i for i, l in enumerate(lines) if re.search(r"\bWindow \(", l))
    below = [re.sub(r"[\s:+\-*]+", " ", l).strip().split(" ")[0] for l in lines[w + 1 :]]
    skip = {"Sort", "Exchange", "AQEShuffleRead", "ShuffleQueryStage", "WindowGroupLimit", "Project"}
    first = next(op for op in below if op not in skip)
    assert first == "HashAggregate"


def test_unread_dimensions_are_not_joined(plans):
    text = plans["yearly_customer"]
    assert "part.parquet" not in text and "supplier.parquet" not in text
    assert "lineitem.parquet" in text
    # payments are never aggregated for a customer report
    assert "o_totalprice" not in text


def test_scan_prunes_columns(plans):
    text = plans["top_category_revenue"]
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", text)
    line = [s for s in schemas if "l_orderkey" in s][0]
    assert "l_shipdate" not in line and "l_suppkey" not in line


AT_SCALE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def no_broadcast(spark):
    """As at scale: no input is small enough to be broadcast."""
    old = {k: spark.conf.get(k, None) for k in AT_SCALE}
    for k, v in AT_SCALE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _scans(nodes, table):
    return [n for n in nodes if kind_of(n) == "FileSourceScanExec" and f"/{table}.parquet" in n.toString()]


@pytest.mark.parametrize("name", ["summary_fingerprint", "yearly_customer", "yearly_transaction", "origin_customer"])
def test_one_item_shuffle_per_report(spark, no_broadcast, name):
    """All parts of a report share one item shuffle; other item scans are the
    NULL-key branch (pushed-down IS NULL, never shuffled)."""
    scans = _scans(plan_nodes(E.queries()[name](spark, SF_DIR)), "lineitem")
    keyed = [n for n in scans if "PushedFilters: [IsNull(" not in n.toString()]
    assert len(keyed) == 1


@pytest.mark.parametrize(
    ("name", "joins"),
    [
        ("yearly_customer", 1),
        ("monthly_customer", 1),
        ("yearly_transaction", 1),
        ("origin_customer", 1),
        ("product_summary", 1),
        ("origin_seller", 2),  # the top city counts distinct orders
    ],
)
def test_fact_joins_per_report(spark, no_broadcast, name, joins):
    """How often the items meet the orders, not counting shared results."""
    found = 0
    for n in plan_nodes(E.queries()[name](spark, SF_DIR)):
        if "Join" in kind_of(n) and "[order_id#" in n.simpleString(200) and "FullOuter" not in n.simpleString(200):
            found += reads(n, "lineitem")
    assert found == joins


def test_customer_reports_join_orders_not_items(spark, no_broadcast):
    """Reports of order columns: the items are counted per order before the join."""
    for name in ("yearly_transaction", "origin_customer", "origin_customer_city"):
        joins = [
            n
            for n in plan_nodes(E.queries()[name](spark, SF_DIR))
            if "Join" in kind_of(n) and "[order_id#" in n.simpleString(200) and reads(n, "lineitem")
        ]
        assert joins
        for join in joins:
            side = next(n for n in below(join) if kind_of(n) in ("HashAggregateExec", "FileSourceScanExec"))
            assert kind_of(side) == "HashAggregateExec", name


@pytest.mark.parametrize("name", ["summary_fingerprint", "origin_customer", "origin_seller", "origin_customer__total_city_state"])
def test_distinct_counts_repeat_no_rows(spark, name):
    assert not [n for n in plan_nodes(E.queries()[name](spark, SF_DIR)) if kind_of(n) == "ExpandExec"]


def test_top_summary_starts_no_job_while_building(spark):
    spark.sparkContext.setJobGroup("top_summary", "no job while building")
    df = E.queries()["top_summary"](spark, SF_DIR)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("top_summary")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not any(p in plan_text(df) for p in PYTHON_NODES)


@pytest.mark.parametrize(
    "name,key",
    [
        ("top_category_revenue", "product_id"),
        ("top_transaction_category", "product_id"),
        ("product_summary", "product_id"),
        ("origin_seller__total_city_state", "seller_id"),
        ("origin_seller__highest_state", "seller_id"),
        ("origin_seller__percentage_state_city", "seller_id"),
    ],
)
def test_dimension_joins_see_aggregates(spark, no_broadcast, name, key):
    """The rows shuffled to meet the product / seller table are aggregates of
    the items, and far fewer than these."""
    nodes = plan_nodes(E.queries()[name](spark, SF_DIR))
    items = sum(rows_out(n) for n in _scans(nodes, "lineitem"))
    found = 0
    for n in nodes:
        if kind_of(n) != "ShuffleExchangeExec" or not reads(n, "lineitem"):
            continue  # the dimension's own side
        if not re.search(rf"hashpartitioning\({key}#\d+L?, \d+\)", n.simpleString(200)):
            continue
        found += 1
        first = next(x for x in below(n) if kind_of(x) in ("HashAggregateExec", "FileSourceScanExec") or "Join" in kind_of(x))
        assert kind_of(first) == "HashAggregateExec", name
        assert rows_out(first) < items / 2, (name, rows_out(first), items)
    assert found > 0


@pytest.mark.parametrize("name", ["top_reorder_category", "origin_seller__highest_city"])
def test_no_aggregate_that_reduces_nothing(spark, no_broadcast, name):
    """The item rows are shuffled for the order join, for the dimension join and
    once to be counted; no aggregate of nearly all of them comes between."""
    nodes = plan_nodes(E.queries()[name](spark, SF_DIR))
    items = sum(rows_out(n) for n in _scans(nodes, "lineitem"))
    large = [n for n in nodes if kind_of(n) == "ShuffleExchangeExec" and reads(n, "lineitem") and n.metrics().apply("shuffleRecordsWritten").value() > items / 5]
    assert 1 <= len(large) <= 3


def test_years_prune_the_stored_fact(spark):
    """On stored facts a workload of some years reads their partitions alone,
    and gives what the base tables give for those years."""
    lazy = Workload(from_tpch(spark, SF_DIR), ADAPTER_PARAMS)
    stored = lazy.with_stored_orders(spark, customers.TRANSACTION_COLS).with_stored_fact(spark)
    reports = all_reports()
    for name in ("yearly_transaction", "top_transaction_category", "origin_seller", "yearly_customer"):
        df = reports[name].build(stored.for_years(1996, 1997))
        scans = [n.toString() for n in plan_nodes(df) if kind_of(n) == "FileSourceScanExec"]
        facts = [x for x in scans if "/marketlens/" in x]
        assert facts and all(re.search(r"PartitionFilters: \[[^\]]*purchase_year", x) for x in facts), name
        base = reports[name].build(lazy.for_years(1996, 1997))
        assert sorted(map(repr, base.collect())) == sorted(map(repr, df.collect())), name
    plan = plan_text(reports["yearly_transaction"].build(lazy.for_years(1996)))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan) or "o_orderdate" in plan
    whole = sorted(map(repr, reports["top_transaction_category"].build(lazy).collect()))
    years = lazy.for_years(*range(1980, 2010))
    assert sorted(map(repr, reports["top_transaction_category"].build(years).collect())) == whole
