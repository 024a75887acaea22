"""Arguments of functions: columns, column names, or plain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def value(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
