"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import queries as own
from lodestrata.llm import sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(own.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
