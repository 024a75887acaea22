"""Definitions and states of indexes, kept as rows of an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The states of an index, and from which states an action may lead where.
STATES = ("empty", "creating", "active", "refreshing", "updating", "deleting", "deleted", "failed", "recovering", "vacuuming", "unknown")
ACTIONS = {
    "create": ({"empty", "deleted"}, "active"),
    "refresh": ({"active", "refreshing"}, "active"),
    "start": ({"active"}, "refreshing"),
    "update": ({"active", "refreshing"}, "active"),
    "fail": ({"active", "refreshing", "recovering"}, "failed"),
    "recover": ({"active", "refreshing", "failed"}, "refreshing"),
    "drop": ({"active", "refreshing", "failed"}, "deleted"),
    "vacuum": ({"deleted"}, "empty"),
}
_SCHEMA = "name string, kind string, source string, definition string, state string, version long"


class Registry:
    """Each action appends one row; an index's state is that of its last version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        empty = self.spark.createDataFrame([], _SCHEMA)
        if not self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            return empty
        return self.spark.read.schema(_SCHEMA).json(self.path)

    def indexes(self) -> DataFrame:
        """One row for each index that has not been vacuumed."""
        last = Window.partitionBy("name").orderBy(F.col("version").desc())
        return self.log().withColumn("__n", F.row_number().over(last)).where("__n = 1 AND state <> 'empty'").drop("__n")

    def apply(self, action: str, name: str, kind: str = "", source: str = "", definition: str = "") -> str:
        """Take an action on an index and return its new state; not every state allows every action."""
        allowed, state = ACTIONS[action]
        found = self.log().where(F.col("name") == name).orderBy(F.col("version").desc()).first()
        now = found["state"] if found else "empty"
        if now not in allowed:
            raise ValueError(f"cannot {action} index {name!r} while it is {now}")
        row = (name, kind or (found["kind"] if found else ""), source or (found["source"] if found else ""), definition or (found["definition"] if found else ""), state, (found["version"] if found else 0) + 1)
        self.spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("append").json(self.path)
        return state
