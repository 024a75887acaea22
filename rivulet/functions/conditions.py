"""Conditions that are never null, and exclusive or."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.functions._args import col


def ispresent(x: Column | str) -> Column:
    return col(x).isNotNull()


def isempty(x: Column | str) -> Column:
    return col(x).isNull() | F.coalesce(col(x) == "", F.lit(False))


def isblank(x: Column | str) -> Column:
    return col(x).isNull() | F.coalesce(F.trim(col(x)) == "", F.lit(False))


def xor(a: Column, b: Column) -> Column:
    """True if just one holds; null if either is null."""
    return a != b
