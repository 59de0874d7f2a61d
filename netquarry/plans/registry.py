"""All queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netquarry.plans import core_problems, graph_queries, more_queries, source_queries, text_queries

_MODULES = (core_problems, graph_queries, text_queries, more_queries, source_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return graph_queries.g_bfs(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of the queries that SQL can express."""
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
