"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a folder of this machine for a local
    master (tests); on a cluster that is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-rivulet-"))
    return found.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table that was written.

    Later steps read the files, so a lost executor costs a re-read, not a recomputation. Results are
    read from them for as long as they are used: the folder is the application's to clear.
    """
    path = new_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
