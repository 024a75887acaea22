"""Nested data: structs and arrays to columns and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from rivulet.operators._cols import Step, quoted


def flatten(column: str, names: Sequence[str] = ()) -> Step:
    """A struct's fields as columns, or an array of structs as rows of such columns.

    Rows whose array is null or empty stay, with nulls. The column itself goes; ``names`` rename
    the new columns.
    """

    def step(df: DataFrame) -> DataFrame:
        kind = df.schema[column].dataType
        inner = kind.elementType if isinstance(kind, ArrayType) else kind
        if not isinstance(inner, StructType):
            raise ValueError(f"{column} is neither a struct nor an array of structs")
        if names and len(names) != len(inner.fields):
            raise ValueError("as many names as the struct has fields")
        kept = [F.col(quoted(c)) for c in df.columns if c != column]
        if isinstance(kind, ArrayType):
            rows = df.select(*kept, F.explode_outer(F.col(quoted(column))).alias("__row"))
            prefix = "__row"
        else:
            rows, prefix = df, quoted(column)
        new = [F.col(f"{prefix}.{quoted(f.name)}").alias(n) for f, n in zip(inner.fields, names or inner.names, strict=True)]
        return rows.select(*kept, *new)

    return step


def expand(column: str, alias: str | None = None) -> Step:
    """A row for each element; rows with a null or empty array go, null elements stay.

    With ``alias`` the elements replace the column, else they are called ``col``. Maps give ``key``
    and ``value``.
    """

    def step(df: DataFrame) -> DataFrame:
        kept = [F.col(quoted(c)) for c in df.columns if not (alias and c == column)]
        e = F.explode(F.col(quoted(column)))
        if isinstance(df.schema[column].dataType, MapType):
            return df.select(*kept, e.alias("key", "value"))
        return df.select(*kept, e.alias(alias or "col"))

    return step
