"""Readers for marketplace exports (Parquet or CSV), one file/folder per table.

Parquet is read with its own schema and then conformed (column subset,
casts); CSV is read as text by the names in its header (further columns and
any order are fine, quoted fields may hold line breaks) and cast to the
explicit schema, never inferred. Column selection and filters placed
downstream still reach the Parquet scan, because conforming is a plain
projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.sources import schemas
from marketlens.sources.tables import MarketTables

_ATTR = {
    "orders_dataset": "orders",
    "customers_dataset": "customers",
    "order_items_dataset": "items",
    "order_payments_dataset": "payments",
    "order_reviews_dataset": "reviews",
    "product_dataset": "products",
    "sellers_dataset": "sellers",
    "geolocation_dataset": "geolocation",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: same names, same order, cast types.

    Timestamps (or ISO text) become DATE, as the reports do day arithmetic.
    """
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.to_date(c)
        elif isinstance(df.schema[f.name].dataType, T.StringType):
            c = c.try_cast(f.dataType)  # unreadable text is NULL
        else:
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_table(
    spark: SparkSession,
    path: str,
    name: str,
    fmt: str = "parquet",
    multi_line: bool = True,
    file_schema: T.StructType | str | None = None,
) -> DataFrame:
    """One table, conformed to its schema.

    ``file_schema`` says how the Parquet columns are stored; no file is opened
    to find out then, which a store of many files or tables is glad of.
    ``multi_line=False`` is for CSV files without quoted line breaks: a large
    file is then split among tasks instead of read whole by one.
    """
    schema = schemas.TABLES[name]
    if fmt == "parquet":
        reader = spark.read if file_schema is None else spark.read.schema(file_schema)
        raw = reader.parquet(path)
    elif fmt == "csv":
        # Without a schema every column is text, named by the header.
        raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return conform(raw, schema)


def read_marketplace(
    spark: SparkSession,
    root: str,
    fmt: str = "parquet",
    suffix: str | None = None,
    multi_line: bool = True,
    file_schemas: dict[str, T.StructType | str] | None = None,
) -> MarketTables:
    """Read ``<root>/<table><suffix>`` for the eight tables.

    ``suffix`` defaults to ``.parquet`` / ``.csv`` by format; ``multi_line``
    and ``file_schemas`` (by table name) as in ``read_table``.
    """
    suffix = suffix if suffix is not None else f".{fmt}"
    root = root.rstrip("/")
    loaded = {
        _ATTR[name]: read_table(spark, f"{root}/{name}{suffix}", name, fmt, multi_line, (file_schemas or {}).get(name))
        for name in schemas.TABLES
    }
    return MarketTables(**loaded)
