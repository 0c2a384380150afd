"""Same results under any partitioning and order of the input rows."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from marketlens.plans import Workload, all_reports
from marketlens.sources import ADAPTER_PARAMS, from_tpch

SF_DIR = "/root/testdata/sf0.001"


def _shuffled(tables, seed):
    """The same rows, dealt anew and in another order."""

    def deal(df):
        mixed = lambda salt: F.xxhash64(*df.columns, F.lit(salt))
        return df.repartition(3 + seed, mixed(seed)).sortWithinPartitions(mixed(-seed))

    return replace(tables, **{name: deal(df) for name, df in tables.as_dict().items()})


# The parts (``<report>__<part>``) are computed within their reports.
@pytest.mark.parametrize("name", [n for n in all_reports() if n != "summary" and "__" not in n])
def test_same_result_any_partitioning(spark, name):
    report = all_reports()[name]
    tables = from_tpch(spark, SF_DIR)
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for seed, n in enumerate(("5", "23")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = tables if seed == 0 else _shuffled(tables, seed)
            results.append(sorted(map(tuple, report.build(Workload(rows, ADAPTER_PARAMS)).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
