"""Sources (marketplace readers, TPC-H adapter) and sinks."""

from marketlens.sources.marketplace import conform, read_marketplace, read_table
from marketlens.sources.sinks import materialize, save_table, stored_table, write_report
from marketlens.sources.tables import MarketTables
from marketlens.sources.tpch_adapter import ADAPTER_PARAMS, from_tpch

__all__ = [
    "ADAPTER_PARAMS",
    "MarketTables",
    "conform",
    "from_tpch",
    "materialize",
    "read_marketplace",
    "read_table",
    "save_table",
    "stored_table",
    "write_report",
]
