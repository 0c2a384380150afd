"""Every registered query equals its oracle SQL (DuckDB) on the test data."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from marketlens.plans import all_reports

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data missing")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else f"{v:.9g}")
    return (2, str(v))


def _canon(cols, rows):
    order = sorted(cols)
    idx = [cols.index(c) for c in order]
    return order, sorted(tuple(_norm(r[i]) for i in idx) for r in rows)


def test_every_report_has_oracle_sql():
    assert set(all_reports()) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(all_reports()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_DIR)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(E.oracle_sql()[name])
    want = _canon(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["date_year", "top_category_revenue", "revenue", "yearly_rank"]
    assert df.count() > 0
