"""SQL users: registered views, and the uniqueness check of the geolocation clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import duplicate_keys
from marketlens.plans import Workload, all_reports
from marketlens.plans.geo import dedupe_geolocation
from marketlens.sources import ADAPTER_PARAMS, from_tpch

SF_DIR = "/root/testdata/sf0.001"


def test_summary_view_agrees_with_the_weighted_fact(spark):
    """Rows and cost per status and purchase month, from SQL on the view and
    from the item-grain fact."""
    w = Workload(from_tpch(spark, SF_DIR), ADAPTER_PARAMS)
    w.register_views(prefix="t_")
    per_month = spark.sql(
        "SELECT order_status, trunc(purchase_date, 'MM') AS m, count(*) AS n, sum(total_cost) AS cost "
        "FROM t_summary GROUP BY ALL"
    )
    fact = w.fact("order_status", "purchase_date", "total_cost")
    ours = fact.groupBy("order_status", F.trunc("purchase_date", "MM").alias("m")).agg(
        F.sum("w").alias("n"), F.sum(F.col("total_cost") * F.col("w")).alias("cost")
    )
    assert {tuple(r) for r in per_month.collect()} == {tuple(r) for r in ours.collect()}
    assert spark.sql("SELECT COUNT(*) FROM t_order_items_dataset").first()[0] > 0


def test_geolocation_prefixes_are_unique(spark):
    geo = dedupe_geolocation(from_tpch(spark, SF_DIR))
    assert duplicate_keys(geo, ["geolocation_zip_code_prefix"]).isEmpty()
    raw = from_tpch(spark, SF_DIR).geolocation
    assert not duplicate_keys(raw, ["geolocation_zip_code_prefix"]).isEmpty()


def test_stored_fact_path_equals_lazy_path_for_every_report(spark):
    """The production run (fact materialised once under spark.checkpoint.dir)
    gives the same result as building each report from the base tables."""
    lazy = Workload(from_tpch(spark, SF_DIR), ADAPTER_PARAMS)
    stored = lazy.with_stored_fact(spark)
    for name, report in all_reports().items():
        a = sorted(map(tuple, report.build(lazy).collect()), key=repr)
        b = sorted(map(tuple, report.build(stored).collect()), key=repr)
        assert a == b, name


def test_run_reports_writes_every_table(spark):
    import os
    import tempfile

    from marketlens.plans.runner import report_tables, run_reports

    out = tempfile.mkdtemp(prefix="marketlens-run-")
    w = Workload(from_tpch(spark, SF_DIR), ADAPTER_PARAMS)
    written = run_reports(spark, w, out)
    assert set(written) == set(report_tables())
    assert "yearly_customer__avg_order" not in written
    for name, path in written.items():
        assert os.path.isdir(path), name
    monthly = spark.read.parquet(written["monthly_customer"])
    assert monthly.count() == all_reports()["monthly_customer"].build(w).count()
    fact_files = os.path.join(spark.conf.get("spark.checkpoint.dir"), "marketlens", spark.sparkContext.applicationId)
    before = set(os.listdir(fact_files)) if os.path.isdir(fact_files) else set()
    # CREATE TABLE IF NOT EXISTS semantics: a second run in "ignore" mode keeps the files
    again = run_reports(spark, w, out, names=["payment_summary"], mode="ignore")
    assert again == {"payment_summary": written["payment_summary"]}
    # Reports of reports read what is stored, even if it is stale, and no fact is written for them.
    stale = spark.createDataFrame([("x", 1, 1, 1, 1), ("y", 3, 1, 1, 1)], spark.read.parquet(written["payment_summary"]).schema)
    stale.write.mode("overwrite").parquet(written["payment_summary"])
    run_reports(spark, w, out, names=["payment_percentage", "payment_summary", "top_summary"], modes={"payment_summary": "ignore"})
    shares = {r[0]: r["percentage"] for r in spark.read.parquet(written["payment_percentage"]).collect()}
    assert shares == {"x": 25.0, "y": 75.0}
    want = sorted(map(tuple, all_reports()["top_summary"].build(w).collect()))
    assert sorted(map(tuple, spark.read.parquet(written["top_summary"]).collect())) == want
    assert (set(os.listdir(fact_files)) if os.path.isdir(fact_files) else set()) == before


def test_run_reports_as_catalog_tables(spark):
    import tempfile
    import uuid

    import pytest

    from marketlens.plans.runner import run_reports, script_modes

    out, db = tempfile.mkdtemp(prefix="marketlens-run-"), f"m{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db}")
    w = Workload(from_tpch(spark, SF_DIR), ADAPTER_PARAMS)
    names = ["geolocation_dataset", "payment_summary"]
    run_reports(spark, w, out, names=names, modes=script_modes(), database=db)
    n = spark.table(f"{db}.payment_summary").count()
    assert n == all_reports()["payment_summary"].build(w).count()
    run_reports(spark, w, out, names=["payment_summary"], modes=script_modes(), database=db)  # kept
    with pytest.raises(Exception):
        run_reports(spark, w, out, names=["geolocation_dataset"], modes=script_modes(), database=db)
    spark.sql(f"DROP DATABASE {db} CASCADE")
