"""All queries of the core, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog_queries, data_queries, imagery_queries, raster_queries, sweep_queries

FLAGSHIP = "d05_recommend"
_MODULES = (data_queries, sweep_queries, raster_queries, catalog_queries, imagery_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
