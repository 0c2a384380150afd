"""Independent DuckDB SQL for checking every registered query."""

from oracle.sql import oracle_sql

__all__ = ["oracle_sql"]
