"""Written intermediate tables, and what operators ask of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rivulet.scratch import save, shared_dir
from rivulet.shipping import ship

__all__ = ["save", "shared_dir", "ship", "shuffle_partitions"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
