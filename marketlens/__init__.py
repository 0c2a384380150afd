"""marketlens: marketplace business-performance analytics on Spark.

The package turns raw marketplace tables (orders, items, customers,
sellers, products, payments, reviews, geolocation) into an enriched
order-item fact and a family of yearly/monthly reports. Every report is a
lazily built DataFrame; nothing is collected to the driver.

Layout
------
``sources``    table schemas, readers for marketplace files, the adapter from
               TPC-H-like tables, report sinks
``functions``  column expressions (exact half-up ratios, calendar parts)
``operators``  reusable DataFrame -> DataFrame analytic operators
``plans``      the enriched fact and the reports built from the operators
"""

from marketlens.params import ReportParams
from marketlens.session import apply_scale_conf, checkpoint_root, local_session

__all__ = ["ReportParams", "apply_scale_conf", "checkpoint_root", "local_session"]
