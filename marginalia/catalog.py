"""All queries over the driver's tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import content_queries, expression_queries, more_queries, search_queries, site_queries, text_queries, views  # noqa: F401  importing them registers their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return dict(views.QUERIES)


def oracle_sql() -> dict[str, str]:
    """The DuckDB statement of each query that has one."""
    return dict(views.SQL)
