"""Registered queries: every operator of the engine applied to the given tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, corpus, retrieval, storage, tenants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in (analytics, corpus, retrieval, storage, tenants) for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in (analytics, corpus, retrieval, storage, tenants) for name, sql in part.SQL.items()}
