"""Arithmetic by name, conversions and comparisons; bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.functions._args import col, value

#: Types by their names in casts.
TYPES = {
    "integer": "int", "int": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "float": "float", "double": "double",
    "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp",
}


def cast(x: Column | str, kind: str) -> Column:
    if kind.lower() not in TYPES:
        raise ValueError(f"unknown type {kind!r}")
    return col(x).try_cast(TYPES[kind.lower()])


def tostring(x: Column | str) -> Column:
    return col(x).cast("string")


def add(a: object, b: object) -> Column:
    return value(a) + value(b)


def subtract(a: object, b: object) -> Column:
    return value(a) - value(b)


def multiply(a: object, b: object) -> Column:
    return value(a) * value(b)


def divide(a: object, b: object) -> Column:
    """Division in doubles; null for a divisor of zero."""
    return F.try_divide(value(a).cast("double"), value(b).cast("double"))


def modulus(a: object, b: object) -> Column:
    """Rest with the dividend's sign; null for a divisor of zero."""
    return F.when(value(b) != 0, value(a) % F.when(value(b) != 0, value(b)))


def truncate(x: Column | str, digits: int = 0) -> Column:
    """Cut towards zero after so many digits."""
    c = col(x).cast("double")
    exact = F.when(F.abs(c) < 1e18, c).cast("decimal(38,18)")  # beyond, a double has no digits after the point
    cut = F.when(exact >= 0, F.floor(exact, F.lit(digits))).otherwise(F.ceil(exact, F.lit(digits)))
    return F.coalesce(cut.cast("double"), c)


def strcmp(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by code points."""
    return F.when(col(a) < col(b), -1).when(col(a) == col(b), 0).when(col(a) > col(b), 1)


def array_length(x: Column | str) -> Column:
    """Null for a null array."""
    return F.array_size(col(x))
