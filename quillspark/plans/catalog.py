"""Registered queries of the portfolio engine, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_analytics, catalog_ingest, catalog_sources, catalog_tools

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**catalog_analytics.QUERIES, **catalog_tools.QUERIES, **catalog_ingest.QUERIES, **catalog_sources.QUERIES}
ORACLE_SQL: dict[str, str] = {**catalog_analytics.ORACLE_SQL, **catalog_tools.ORACLE_SQL, **catalog_ingest.ORACLE_SQL, **catalog_sources.ORACLE_SQL}
