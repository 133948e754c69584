"""All queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, fields, retrieval

Query = Callable[[SparkSession, str], DataFrame]

CORE_QUERIES: dict[str, Query] = retrieval.QUERIES | corpus.QUERIES | fields.QUERIES
CORE_ORACLE_SQL: dict[str, str] = retrieval.ORACLE_SQL | corpus.ORACLE_SQL | fields.ORACLE_SQL


def flagship(spark: SparkSession, data_dir: str) -> DataFrame:
    """Weighted ranking of the chunks for the stated evaluation items."""
    return retrieval.bm25_top(spark, data_dir)
