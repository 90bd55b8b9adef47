"""All queries outside the text subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import core_problems, engine_queries, index_queries, review_queries, upkeep_queries

MODULES = [core_problems, index_queries, review_queries, engine_queries, upkeep_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of all records, their column roles, scored candidates, and every entity with the fields that hold it."""
    return index_queries.agg3_entity_links(spark, folder)
