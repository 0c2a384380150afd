"""Marketplace readers and report sinks."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketlens.plans import Workload, all_reports
from marketlens.sources import ADAPTER_PARAMS, from_tpch, read_marketplace, stored_table, write_report
from marketlens.sources.schemas import TABLES

SF_DIR = "/root/testdata/sf0.001"

_EXPORT = {
    "orders_dataset": "orders",
    "customers_dataset": "customers",
    "order_items_dataset": "items",
    "order_payments_dataset": "payments",
    "order_reviews_dataset": "reviews",
    "product_dataset": "products",
    "sellers_dataset": "sellers",
    "geolocation_dataset": "geolocation",
}


def _export(spark, fmt: str) -> str:
    """Write the adapter tables as a marketplace export (ids as text)."""
    root = tempfile.mkdtemp(prefix=f"marketlens-export-{fmt}-")
    tables = from_tpch(spark, SF_DIR)
    for name, attr in _EXPORT.items():
        df = getattr(tables, attr)
        df = df.select([F.col(c).cast("string") if c.endswith("_id") or c.endswith("_prefix") else F.col(c) for c in df.columns])
        path = os.path.join(root, f"{name}.{fmt}")
        if fmt == "csv":
            df.write.option("header", True).csv(path)
        else:
            df.write.parquet(path)
    return root


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_read_marketplace_runs_reports(spark, fmt):
    root = _export(spark, fmt)
    tables = read_marketplace(spark, root, fmt=fmt)
    for name, schema in TABLES.items():
        got = getattr(tables, _EXPORT[name]).schema
        assert [f.name for f in got.fields] == [f.name for f in schema.fields]
        assert [f.dataType for f in got.fields] == [f.dataType for f in schema.fields]
    reports = all_reports()
    direct = Workload(from_tpch(spark, SF_DIR), ADAPTER_PARAMS)
    exported = Workload(tables, ADAPTER_PARAMS)
    for name in ("yearly_customer", "yearly_transaction", "origin_seller", "payment_summary"):
        assert _rows(reports[name].build(exported)) == _rows(reports[name].build(direct)), name


def test_csv_is_read_by_header_name(spark):
    """Further columns, another order and quoted line breaks, in all tables."""
    tables = from_tpch(spark, SF_DIR)
    root = tempfile.mkdtemp(prefix="marketlens-header-")
    for name, attr in _EXPORT.items():
        df = getattr(tables, attr)
        note = F.lit('two\nlines, one "quoted" word').alias("note")
        odd = df.select(note, *reversed(df.columns), F.lit(1).alias("more"))
        odd.write.csv(os.path.join(root, f"{name}.csv"), header=True, escape='"')
    got = read_marketplace(spark, root, fmt="csv")
    for name, attr in _EXPORT.items():
        want = getattr(tables, attr)
        columns = [F.col(f.name).cast(f.dataType) for f in TABLES[name].fields]
        assert _rows(getattr(got, attr)) == _rows(want.select(columns)), name


def test_write_report_modes(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="marketlens-sink-"), "report")
    first = spark.range(3).withColumn("v", F.lit(1))
    second = spark.range(5).withColumn("v", F.lit(2))
    write_report(first, out, mode="errorifexists", order_by=["id"])
    write_report(second, out, mode="ignore")  # CREATE TABLE IF NOT EXISTS keeps the stale table
    assert spark.read.parquet(out).count() == 3
    write_report(second, out, mode="overwrite")
    assert spark.read.parquet(out).agg(F.max("v")).first()[0] == 2
    with pytest.raises(Exception):
        write_report(first, out, mode="errorifexists")
    with pytest.raises(ValueError):
        write_report(first, out, mode="bogus")


def test_filters_and_pruning_reach_the_parquet_scan(spark):
    root = _export(spark, "parquet")
    w = Workload(read_marketplace(spark, root, fmt="parquet"), ADAPTER_PARAMS)
    df = all_reports()["top_category_revenue"].build(w)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    orders_scan = [l for l in plan.splitlines() if "FileScan parquet" in l and "orders_dataset" in l]
    assert orders_scan and all("EqualTo(order_status,delivered)" in l for l in orders_scan)
    items_scan = [l for l in plan.splitlines() if "FileScan parquet" in l and "order_items_dataset" in l]
    assert items_scan
    for line in items_scan:
        schema = line.split("ReadSchema: ")[1]
        assert "shipping_limit_date" not in schema and "seller_id" not in schema


def test_cli_runs_the_workload_on_an_export(spark):
    from marketlens.cli import main

    root = _export(spark, "parquet")
    out = tempfile.mkdtemp(prefix="marketlens-cli-")
    written = main(
        [
            "--input", root, "--output", out,
            "--reports", "yearly_customer,payment_summary",
            "--home-state", "ASIA", "--home-city", "NATION_1", "--payment-years", "1996,1997,1998",
        ],
        spark=spark,
    )
    assert set(written) == {"yearly_customer", "payment_summary"}
    got = spark.read.parquet(written["payment_summary"])
    assert got.columns == ["payment_type", "total_transaction", "1996", "1997", "1998"]
    direct = all_reports()["payment_summary"].build(Workload(from_tpch(spark, SF_DIR), ADAPTER_PARAMS))
    assert _rows(got) == _rows(direct)


def test_save_table_modes_with_external_path(spark):
    from marketlens.sources import save_table

    path = os.path.join(tempfile.mkdtemp(prefix="marketlens-table-"), "t")
    name = f"marketlens_ctas_{os.getpid()}"
    save_table(spark.range(3), name, mode="errorifexists", path=path)
    save_table(spark.range(7), name, mode="ignore", path=path)  # IF NOT EXISTS keeps it
    assert spark.table(name).count() == 3
    save_table(spark.range(7), name, mode="overwrite", path=path)
    assert spark.table(name).count() == 7
    with pytest.raises(Exception):
        save_table(spark.range(1), name, mode="errorifexists", path=path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def _failing(spark):
    """Rows of which the last fails when it is computed."""
    bad = F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.lit(1))
    return spark.range(1000, numPartitions=4).withColumn("v", bad.cast("int"))


@pytest.mark.parametrize("mode", ["overwrite", "ignore", "errorifexists"])
def test_failed_write_leaves_no_table(spark, mode):
    root = tempfile.mkdtemp(prefix="marketlens-fail-")
    out = os.path.join(root, "report")
    with pytest.raises(Exception, match="lost"):
        write_report(_failing(spark), out, mode=mode)
    assert os.listdir(root) == [] and stored_table(spark, out) is None
    # What an unfinished write of another program left counts as no table.
    os.makedirs(os.path.join(out, "_temporary", "0"))
    assert stored_table(spark, out) is None
    write_report(spark.range(3), out, mode=mode)
    assert stored_table(spark, out).count() == 3 and os.listdir(root) == ["report"]


def test_failed_overwrite_keeps_the_old_table(spark):
    root = tempfile.mkdtemp(prefix="marketlens-fail-")
    out = os.path.join(root, "report")
    write_report(spark.range(5), out)
    with pytest.raises(Exception, match="lost"):
        write_report(_failing(spark), out)
    assert spark.read.parquet(out).count() == 5 and os.listdir(root) == ["report"]
    # A failed append shows none of its rows.
    with pytest.raises(Exception, match="lost"):
        write_report(_failing(spark).filter("v = 1").select("id"), out, mode="append")
    assert spark.read.parquet(out).count() == 5
    write_report(spark.range(2), out, mode="append")
    assert spark.read.parquet(out).count() == 7


@pytest.mark.parametrize("external", [True, False])
def test_failed_catalog_write_keeps_the_old_table(spark, external):
    from marketlens.sources import save_table

    path = os.path.join(tempfile.mkdtemp(prefix="marketlens-table-"), "t") if external else None
    name = f"marketlens_fail_{os.getpid()}_{int(external)}"
    save_table(spark.range(5), name, path=path)
    with pytest.raises(Exception, match="lost"):
        save_table(_failing(spark), name, path=path)
    assert spark.table(name).count() == 5
    save_table(spark.range(9), name, path=path)
    assert spark.table(name).count() == 9
    save_table(spark.range(1), name, mode="append", path=path)
    assert spark.table(name).count() == 10
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name]
    spark.sql(f"DROP TABLE {name}")


def test_run_after_a_failed_run(spark):
    """A report folder left empty, and a failing report: the next run is whole."""
    from dataclasses import replace

    from marketlens.plans.runner import run_reports

    out = tempfile.mkdtemp(prefix="marketlens-rerun-")
    w = Workload(from_tpch(spark, SF_DIR), ADAPTER_PARAMS)
    os.makedirs(os.path.join(out, "payment_summary"))
    pays = w.tables.payments
    bad = F.when(F.col("order_id") % 997 == 5, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("payment_type"))
    broken = replace(w, tables=replace(w.tables, payments=pays.withColumn("payment_type", bad)))
    with pytest.raises(Exception, match="lost"):
        run_reports(spark, broken, out, names=["payment_summary"], mode="ignore")
    assert stored_table(spark, os.path.join(out, "payment_summary")) is None
    written = run_reports(spark, w, out, names=["payment_summary", "payment_percentage"], mode="ignore")
    for name, path in written.items():
        assert _rows(spark.read.parquet(path)) == _rows(all_reports()[name].build(w)), name


def test_parquet_with_a_given_schema_opens_no_file(spark):
    root = _export(spark, "parquet")
    known = read_marketplace(spark, root)
    file_schemas = {n: spark.read.parquet(f"{root}/{n}.parquet").schema for n in TABLES}
    spark.sparkContext.setJobGroup("handles", "no job for a handle")
    got = read_marketplace(spark, root, file_schemas=file_schemas)
    from_tpch(spark, SF_DIR)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("handles")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert _rows(got.orders) == _rows(known.orders)
