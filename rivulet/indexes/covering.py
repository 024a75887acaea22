"""Covering indexes: a copy of some columns (and rows) of a table, read in its place where it suffices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Condition = tuple[str, str, object]


@dataclass(frozen=True)
class CoveringIndex:
    source: str
    path: str
    columns: tuple[str, ...]
    condition: tuple[Condition, ...] = ()

    def refresh(self, spark: SparkSession) -> None:
        """Write the index anew; with a sort column first in ``columns`` its files can be skipped by their footers."""
        _filtered(spark.read.parquet(self.source), self.condition).select(*self.columns).write.mode("overwrite").parquet(self.path)

    def covers(self, columns: Sequence[str], conditions: Sequence[Condition]) -> bool:
        """Whether the index has all columns, and all rows that meet the conditions."""
        needed = {*columns, *(c for c, _, _ in conditions)}
        return needed <= set(self.columns) and all(any(implies(q, mine) for q in conditions) for mine in self.condition)


def implies(given: Condition, wanted: Condition) -> bool:
    """Whether rows that meet ``given`` meet ``wanted``: comparisons of one column with a constant."""
    (c, op, v), (column, limit_op, limit) = given, wanted
    if c != column or v is None or limit is None:
        return False
    if limit_op == "=":
        return op == "=" and v == limit
    if limit_op in (">", ">="):
        return op in ("=", ">", ">=") and (v > limit or (v == limit and (limit_op == ">=" or op == ">")))
    if limit_op in ("<", "<="):
        return op in ("=", "<", "<=") and (v < limit or (v == limit and (limit_op == "<=" or op == "<")))
    return False


def _filtered(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    for column, op, value in conditions:
        c, v = F.col(column), F.lit(value)
        df = df.where({"=": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op])
    return df


def read(spark: SparkSession, source: str, columns: Sequence[str], conditions: Sequence[Condition], indexes: Sequence[CoveringIndex]) -> DataFrame:
    """Columns of the rows of ``source`` that meet the conditions, from the narrowest index that covers them."""
    usable = [i for i in indexes if i.source == source and i.covers(columns, conditions)]
    path = min(usable, key=lambda i: (len(i.columns), -len(i.condition))).path if usable else source
    return _filtered(spark.read.parquet(path), conditions).select(*columns)
