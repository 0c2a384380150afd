"""Geolocation clean-up: one row per zip prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketlens.operators import modal_row
from marketlens.sources.tables import MarketTables

GEO_VALUES = ("geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state")


def dedupe_geolocation(t: MarketTables) -> DataFrame:
    """Most frequent (lat, lng, city, state) per zip prefix; ties to the
    smallest tuple."""
    return modal_row(t.geolocation, "geolocation_zip_code_prefix", GEO_VALUES)
