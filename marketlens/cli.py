"""Command line / spark-submit entry point: run the whole workload.

    spark-submit --py-files marketlens.zip marketlens/cli.py \\
        --input s3://bucket/marketplace --output s3://bucket/reports

    python -m marketlens --input DIR --output DIR [--format csv] [--mode ignore]
        [--reports yearly_customer,top_summary] [--home-state SP] ...

The session comes from ``getOrCreate`` (cluster settings from spark-submit);
``SCALE_CONF`` is applied on top, and ``spark.checkpoint.dir`` must name a
shared folder (the fact is materialised there once).
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from marketlens.params import ReportParams
from marketlens.plans.runner import report_tables, run_reports
from marketlens.plans.workload import Workload
from marketlens.session import apply_scale_conf
from marketlens.sources.marketplace import read_marketplace
from marketlens.sources.sinks import SAVE_MODES


def parse_args(argv: Sequence[str] | None = None) -> argparse.Namespace:
    defaults = ReportParams()
    p = argparse.ArgumentParser(prog="marketlens", description=__doc__.split("\n")[0])
    p.add_argument("--input", required=True, help="folder with the eight marketplace tables")
    p.add_argument("--output", required=True, help="folder for the report tables")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    p.add_argument("--mode", default="overwrite", choices=SAVE_MODES)
    p.add_argument("--reports", default="", help="comma-separated names (default: all)")
    p.add_argument("--home-state", default=defaults.home_state)
    p.add_argument("--home-city", default=defaults.home_city)
    p.add_argument(
        "--payment-years",
        default=",".join(str(y) for y in defaults.payment_years),
        help="comma-separated years shown as columns of payment_summary",
    )
    return p.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    args = parse_args(argv)
    spark = spark or SparkSession.builder.appName("marketlens").getOrCreate()
    apply_scale_conf(spark)
    params = ReportParams(
        home_state=args.home_state,
        home_city=args.home_city,
        payment_years=tuple(int(y) for y in args.payment_years.split(",") if y),
    )
    tables = read_marketplace(spark, args.input, fmt=args.format)
    names = [n for n in args.reports.split(",") if n] or report_tables()
    written = run_reports(spark, Workload(tables, params), args.output, names, args.mode)
    print(json.dumps(written))
    return written


if __name__ == "__main__":
    main()
