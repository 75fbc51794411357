"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import graph_queries, metric_queries, records

MODULES = (records, graph_queries, metric_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query the driver's smoke check runs."""
    return graph_queries.degree_centrality_top10(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
