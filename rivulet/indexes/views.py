"""Materialised views: the result of a query as a table; see :mod:`rivulet.streaming` for incremental refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def refresh_full(spark: SparkSession, source: str, query: Callable[[DataFrame], DataFrame], target: str) -> DataFrame:
    """Compute the view from the whole table, replace ``target``, and return it."""
    out = query(spark.read.parquet(source))
    out.write.mode("overwrite").parquet(target)
    return spark.read.schema(out.schema).parquet(target)
