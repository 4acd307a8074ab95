"""All queries of the engine's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.plans import more_plans, prepared_plans, search_plans, text_plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = text_plans.QUERIES | search_plans.QUERIES | more_plans.QUERIES | prepared_plans.QUERIES
SQL: dict[str, str] = text_plans.SQL | search_plans.SQL | more_plans.SQL | prepared_plans.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks by BM25 for each query passage."""
    return search_plans.bm25_search(spark, sf_dir)
