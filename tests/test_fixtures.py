"""Micro-fixtures with hand-computed answers (one per quirk group)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import D, item, make_tables, order, rows
from marketlens.operators import share_topn_others, top_k_per_group, zip_by_position
from marketlens.params import ReportParams
from marketlens.plans import Workload, build_summary
from marketlens.plans.dimensions import Dimensions
from marketlens.plans.fact import build_fact
from marketlens.plans import customers as C
from marketlens.plans import geo, origin, payments, products

P = ReportParams()


def _geo(spark, tuples):
    t = make_tables(spark, geolocation=[("z1", *tp) for tp in tuples])
    return rows(geo.dedupe_geolocation(t))


def test_f1_modal_row_tie_goes_to_smallest_tuple(spark):
    tuples = [(1.0, 1.0, "x", "s")] * 2 + [(2.0, 2.0, "y", "s")] * 2 + [(3.0, 3.0, "z", "s")]
    got = _geo(spark, tuples)
    assert got == [
        {
            "geolocation_zip_code_prefix": "z1",
            "geolocation_lat": 1.0,
            "geolocation_lng": 1.0,
            "geolocation_city": "x",
            "geolocation_state": "s",
        }
    ]


def test_f2_modal_row_keeps_null_of_winner(spark):
    got = _geo(spark, [(1.0, None, "x", "s")] * 2 + [(2.0, 2.0, "y", "s")])
    assert got[0]["geolocation_lat"] == 1.0 and got[0]["geolocation_lng"] is None


def _one_customer(spark, dates):
    t = make_tables(
        spark,
        customers=[("c1", "u1", "city", "st")],
        orders=[order(f"o{i}", "c1", purchase=d) for i, d in enumerate(dates)],
        items=[item(f"o{i}") for i in range(len(dates))],
    )
    return t


def test_f3_day_diff(spark):
    t = _one_customer(spark, [D(2017, 1, 1), D(2017, 1, 1), D(2017, 1, 2), D(2017, 1, 6)])
    s = build_fact(t, C.GROWTH_COLS)
    got = rows(C.day_diff(s))
    # taus 1, 0, 3 (the last row has no successor): mean 4/3
    assert got == [{"date_year": 2017, "day_diff": 1.33}]


def test_f4_tie_at_rank_five_keeps_more_names(spark):
    counts = dict(a=30, b=20, c=15, d=10, e=5, f=5, g=5, h=4, i=3, j=3)
    ents = [(f"{city}{n}", city, "st") for city, k in counts.items() for n in range(k)]
    df = spark.createDataFrame(ents, "id string, city string, state string")
    got = {r["top_5"]: r for r in rows(share_topn_others(df, ["id", "city", "state"], "city", 3, "total_cities"))}
    assert len(got) == 8
    assert got["e"]["total_percentage"] == 5.0 and got["g"]["total_cities"] == 1
    assert got["others"]["total_percentage"] == 10.0 and got["others"]["total_cities"] == 3


def test_f5_null_revenue_ranks_first(spark):
    df = spark.createDataFrame(
        [(1, "a", 10), (1, "b", None), (1, "c", 20)], "y int, name string, revenue int"
    )
    got = top_k_per_group(df, ["y"], "revenue", 3)
    assert {r["name"]: r["yearly_rank"] for r in rows(got)} == {"b": 1, "c": 2, "a": 3}


def test_f7_repeat_customer_by_rows(spark):
    t = make_tables(
        spark,
        customers=[("c1", "u1", "city", "st")],
        orders=[order("o1", "c1")],
        items=[item("o1", 1), item("o1", 2)],
    )
    s = build_fact(t, C.GROWTH_COLS)
    assert rows(C.repeat_order_cust(s)) == [{"date_year": 2017, "repeat_order_cust": 1}]
    assert rows(C.avg_order(s)) == [{"date_year": 2017, "avg_order": 2.0}]
    # Counted by order, the two items are one transaction.
    by_order = ReportParams(grain="order")
    assert rows(C.repeat_order_cust(s, by_order)) == []
    assert rows(C.avg_order(s, by_order)) == [{"date_year": 2017, "avg_order": 1.0}]
    stats = rows(C.yearly_stats(s, by_order))[0]
    assert (stats["highest_transaction_by_user"], stats["percentage_1transaction"]) == (1, 100.0)
    assert rows(C.yearly_stats(s))[0]["highest_transaction_by_user"] == 2
    assert rows(C.mode_of_transaction(s, by_order))[0]["mode_of_transaction"] == 1
    assert rows(C.day_diff(s, by_order)) == [] and rows(C.day_diff(s)) == [{"date_year": 2017, "day_diff": 1.0}]
    assert rows(C.avg_unique_items(s, by_order)) == rows(C.avg_unique_items(s))


def test_f7_order_grain_from_any_fact(spark):
    """Two orders of one customer, three items and two reviews of one of them,
    and items without an order: the same from a fact of orders and of items."""
    t = make_tables(
        spark,
        customers=[("c1", "u1", "city", "st")],
        orders=[order("o1", "c1"), order("o2", "c1", purchase=D(2017, 1, 4))],
        items=[item("o1", 1), item("o1", 2), item("o1", 3), item("o2", 1), item(None, 1), item(None, 2)],
        reviews=[("o1", 5), ("o1", 2)],
    )
    by_item = build_fact(t, [*C.TRANSACTION_COLS, "order_item_id"])
    by_order = build_fact(t, C.TRANSACTION_COLS)
    assert (by_item.count(), by_order.count()) == (6, 3)
    assert {r.order_id: (r.w, r.score_sum, r.score_n) for r in by_order.collect()} == {
        "o1": (6, 21, 6), "o2": (1, 0, 0), None: (2, 0, 0),
    }
    for grain in ("row", "order"):
        p = ReportParams(grain=grain)
        for report in (C.yearly_transaction, C.yearly_customer, C.mode_of_transaction):
            a, b = (sorted(map(repr, rows(report(fact, p)))) for fact in (by_item, by_order))
            assert a == b, (report.__name__, grain)
    got = {r["date_year"]: r for r in rows(C.yearly_stats(by_order, ReportParams(grain="order")))}
    assert got[2017]["highest_transaction_by_user"] == 2 and got[None]["highest_transaction_by_user"] == 1
    assert rows(C.day_diff(by_order, ReportParams(grain="order"))) == [{"date_year": 2017, "day_diff": 2.0}]
    with pytest.raises(ValueError):
        ReportParams(grain="item")


def test_f8_review_fan_out(spark):
    t = make_tables(
        spark,
        customers=[("c1", "u1", "city", "st")],
        orders=[order("o1", "c1", est=D(2017, 2, 1))],
        items=[item("o1", price=10.0, freight=1.0)],
        reviews=[("o1", 5), ("o1", 1)],
        products=[("p1", "cat", 1.0)],
    )
    s = build_summary(t)
    assert s.count() == 2
    assert [r["review_score"] for r in rows(build_summary(t, dedupe_reviews=True))] == [1]
    assert build_fact(t).agg({"w": "sum"}).first()[0] == 2
    assert rows(C.avg_rating(build_fact(t, ["purchase_date", "review_score"]))) == [
        {"date_year": 2017, "avg_rating": 3.0}
    ]
    rev = rows(products.yearly_revenue(build_fact(t, products.REVENUE_COLS), P))
    assert float(rev[0]["revenue"]) == 22.0


def test_f9_item_with_missing_dimensions_survives(spark):
    t = make_tables(spark, items=[item("o9", pid="px", sid="sx", price=1.005, freight=0.0)])
    got = rows(build_summary(t))
    assert len(got) == 1
    r = got[0]
    assert r["order_status"] is None and r["product_category"] is None
    assert r["seller_city"] is None and r["purchase_date"] is None
    assert r["total_cost"] is not None


def test_f10_month_without_new_customers(spark):
    cs = [(f"c{i}", f"u{i}", "city", "st") for i in range(3)]
    os_ = [order(f"j{i}", f"c{i}", purchase=D(2017, 1, 5)) for i in range(3)]
    os_ += [order(f"f{i}", f"c{i}", purchase=D(2017, 2, 5)) for i in range(3)]
    its = [item(o[0]) for o in os_]
    t = make_tables(spark, customers=cs, orders=os_, items=its)
    got = {r["date_month"]: r for r in rows(C.monthly_customer(build_fact(t, C.GROWTH_COLS)))}
    assert got[2]["new_customer"] == 0 and got[2]["old_customer"] == 3
    assert got[2]["total_customer"] == 3
    assert got[1]["new_customer"] == 3 and got[1]["old_customer"] == 0


def test_f11_reorder_excludes_single_purchase(spark):
    cs = [("c1", "u1", "x", "s"), ("c2", "u2", "x", "s")]
    os_ = [order(f"o{i}", "c1", est=D(2017, 3, 1)) for i in range(3)] + [
        order("o9", "c2", est=D(2017, 3, 1))
    ]
    its = [item(o[0], pid="p1") for o in os_]
    t = make_tables(spark, customers=cs, orders=os_, items=its, products=[("p1", "cat", 1.0)])
    got = rows(
        products.top_reorder_product(
            build_fact(t, products.REORDER_PRODUCT_COLS), P, Dimensions.of(t)
        )
    )
    assert got == [
        {
            "date_year": 2017,
            "product_category": "cat",
            "top_product_id": "p1",
            "total_reorder": 2,
            "yearly_rank": 1,
        }
    ]


def test_f12_zip_truncates_to_shortest(spark):
    parts = []
    for i, n in enumerate((4, 3, 3, 5)):
        df = spark.range(n).select(F.col("id").alias(f"v{i}"))
        parts.append((df, [f"v{i}"]))
    got = rows(zip_by_position(parts).orderBy("rn"))
    assert [r["rn"] for r in got] == [1, 2, 3]
    assert all(r["v0"] == r["v3"] == r["rn"] - 1 for r in got)


def test_f13_payment_pivot_nulls(spark):
    os_ = [
        order("o1", "c1", est=D(2016, 5, 1)),
        order("o2", "c1", est=D(2019, 5, 1)),
        order("o3", "c1", est=D(2017, 5, 1)),
        order("o4", "c1", est=D(2017, 5, 1)),
    ]
    pays = [
        ("o1", 1, "a", 1, 1.0),
        ("o2", 1, "a", 1, 1.0),
        ("o3", 1, "not_defined", 1, 1.0),
        ("o4", 1, None, 1, 1.0),
    ]
    t = make_tables(spark, orders=os_, payments=pays)
    got = rows(payments.payment_summary(t, P))
    assert got == [
        {"payment_type": "a", "total_transaction": 2, "2016": 1, "2017": None, "2018": None}
    ]


def test_f14_tied_winners_multiply(spark):
    # states s1 and s2 tie at 3 rows; cities x1, x2, x3 tie at 2 rows
    cs = [
        ("c1", "u1", "x1", "s1"),
        ("c2", "u2", "x2", "s1"),
        ("c3", "u3", "x2", "s2"),
        ("c4", "u4", "x3", "s2"),
    ]
    os_ = [order(f"o{i}", f"c{i}") for i in range(1, 5)]
    its = [item("o1", 1), item("o1", 2), item("o2"), item("o3"), item("o4", 1), item("o4", 2)]
    t = make_tables(spark, customers=cs, orders=os_, items=its)
    s = build_fact(t, origin.origin_cols("customer"))
    got = rows(origin.origin(s, "customer", P))
    assert len(got) == 6
    assert {r["highest_customer_state"] for r in got} == {"s1", "s2"}
    assert {r["highest_customer_city"] for r in got} == {"x1", "x2", "x3"}


def test_f15_year_bases_of_product_summary(spark):
    os_ = [
        order("o1", "c1", status="canceled", purchase=D(2016, 1, 1), approved=D(2016, 1, 2)),
        order("o2", "c1", status="delivered", purchase=D(2017, 1, 1), est=D(2017, 2, 1)),
    ]
    t = make_tables(spark, orders=os_, items=[item("o1"), item("o2")], products=[("p1", "cat", 1.0)])
    got = rows(
        products.product_summary(build_fact(t, products.PRODUCT_SUMMARY_COLS), P, Dimensions.of(t))
    )
    assert len(got) == 1
    assert got[0]["date_year"] == 2017 and got[0]["total_cancel"] is None


def test_f16_seller_city_counts_orders(spark):
    t = make_tables(
        spark,
        orders=[order("o1", "c1")],
        items=[item("o1", n) for n in (1, 2, 3)],
        sellers=[("s1", "town", "ST")],
    )
    s = build_fact(t, (*origin.origin_cols("seller"), "order_id"))
    d = Dimensions.of(t)
    assert rows(origin.highest_city(s, "seller", d))[0]["total_transaction_in_city"] == 1
    assert rows(origin.highest_state(s, "seller", d))[0]["total_transaction_in_state"] == 3


def test_f17_payment_percentage(spark):
    os_ = [order(f"o{i}", "c1") for i in range(4)]
    pays = [("o0", 1, "a", 1, 1.0), ("o1", 1, "a", 1, 1.0), ("o2", 1, "a", 1, 1.0), ("o3", 1, "b", 1, 1.0)]
    t = make_tables(spark, orders=os_, payments=pays)
    got = {r["payment_type"]: r["percentage"] for r in rows(payments.payment_percentage(t, P))}
    assert got == {"a": 75.0, "b": 25.0}


def test_f18_city_counts_distinct_triples(spark):
    t = make_tables(
        spark,
        customers=[("c1", "u1", "same", "s1"), ("c2", "u1", "same", "s2")],
        orders=[order("o1", "c1"), order("o2", "c2")],
        items=[item("o1"), item("o2")],
    )
    s = build_fact(t, origin.share_cols("customer"))
    got = rows(origin.origin_share(s, "customer", "city", 3, "total_cities", P))
    assert got == [{"top_5": "same", "total_percentage": 100.0, "total_cities": 1}]


def test_f19_null_customer_not_counted_as_new(spark):
    t = make_tables(
        spark,
        customers=[("c1", "u1", "x", "s")],
        orders=[order("o1", "c1"), order("o2", "missing")],
        items=[item("o1"), item("o2")],
    )
    got = rows(C.new_customer(build_fact(t, C.GROWTH_COLS)))
    assert got == [{"date_year": 2017, "new_customer": 1}]


def test_f20_null_approval_lands_in_no_year(spark):
    os_ = [
        order("o1", "c1", status="canceled", approved=None),
        order("o2", "c1", status="delivered", est=D(2017, 3, 1)),
    ]
    t = make_tables(spark, orders=os_, items=[item("o1"), item("o2")], products=[("p1", "cat", 1.0)])
    s = build_fact(t, products.PRODUCT_SUMMARY_COLS)
    assert rows(products.yearly_cancel(s, P)) == [{"date_year": None, "total_cancel": 1}]
    got = rows(products.product_summary(s, P, Dimensions.of(t)))
    assert got[0]["total_cancel"] is None and got[0]["most_canceled"] is None


def test_workload_stored_fact_matches_lazy(spark):
    t = _one_customer(spark, [D(2017, 1, 1), D(2017, 3, 4), D(2018, 1, 2)])
    lazy = Workload(t, P)
    stored = lazy.with_stored_fact(spark)
    a = sorted(map(tuple, C.yearly_customer(lazy.fact(*C.GROWTH_COLS)).collect()))
    b = sorted(map(tuple, C.yearly_customer(stored.fact(*C.GROWTH_COLS)).collect()))
    assert a == b and len(a) == 2
