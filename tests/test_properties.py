"""Whole-report properties on the test data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketlens.plans import Workload, all_reports, build_summary
from marketlens.sources import ADAPTER_PARAMS, from_tpch

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def work(spark):
    return Workload(from_tpch(spark, SF_DIR), ADAPTER_PARAMS)


@pytest.fixture(scope="module")
def reports():
    return all_reports()


def run(reports, name, w):
    return reports[name].build(w).collect()


@pytest.mark.parametrize(
    "name,dp",
    [
        ("origin_customer_city", 3),
        ("origin_customer_state", 3),
        ("origin_seller_city", 2),
        ("origin_seller_state", 2),
    ],
)
def test_shares_total_100_within_rounding(reports, work, name, dp):
    rows = run(reports, name, work)
    count_col = [c for c in rows[0].asDict() if c.startswith("total_") and c != "total_percentage"][0]
    labels = sum(r[count_col] for r in rows)
    total = sum(r.total_percentage for r in rows)
    assert abs(total - 100) <= labels * 0.5 * 10**-dp + 1e-9


def test_new_plus_old_is_total(reports, work):
    for r in run(reports, "monthly_customer", work):
        assert r.new_customer + r.old_customer == r.total_customer
        assert r.new_customer >= 0 and r.old_customer >= 0


def test_new_customers_sum_to_distinct_customers(spark, reports, work):
    new = sum(r.new_customer or 0 for r in run(reports, "yearly_customer__new_customer", work))
    s = build_summary(work.tables, ["customer_unique_id"])
    assert new == s.agg(F.countDistinct("customer_unique_id")).first()[0]


@pytest.mark.parametrize(
    "name,year",
    [
        ("top_category_revenue", "date_year"),
        ("top_reorder_product", "date_year"),
        ("top_reorder_category", "date_year"),
        ("top_transaction_category", "purchase_year"),
        ("origin_customer__highest_state", "date_year"),
        ("origin_seller__highest_city", "date_year"),
    ],
)
def test_ranks_start_at_one_in_every_group(reports, work, name, year):
    best: dict = {}
    for r in run(reports, name, work):
        best[r[year]] = min(best.get(r[year], 99), r.yearly_rank)
    assert best and set(best.values()) == {1}


def test_zip_length_is_shortest_input(reports, work):
    lengths = [
        len(run(reports, n, work))
        for n in ("top_reorder_category", "top_reorder_product", "top_category_revenue", "top_transaction_category")
    ]
    rows = run(reports, "top_summary", work)
    assert len(rows) == min(lengths)
    assert sorted(r.rn for r in rows) == list(range(1, len(rows) + 1))


def test_payment_percentages_total_100(reports, work):
    rows = run(reports, "payment_percentage", work)
    assert abs(sum(r.percentage for r in rows) - 100) <= len(rows) * 0.05 + 1e-9
    summary = {r.payment_type: r.total_transaction for r in run(reports, "payment_summary", work)}
    assert summary == {r.payment_type: r.total_transaction for r in rows}
