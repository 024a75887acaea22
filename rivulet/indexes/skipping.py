"""File-skipping indexes: one row of sketches for each file of a table.

A build is one aggregation by file. A read asks the sketches which files can hold matching rows
and lets Spark read those, together with all files that came after the build.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("PARTITION", "VALUE_SET", "MIN_MAX", "BLOOM_FILTER")
_BITS, _HASHES = 32768, 3  # bits in one of Spark's bitmaps; bitmaps of a filter

#: What is recommended for a column by its type.
RECOMMENDED = {
    "boolean": "VALUE_SET", "int": "MIN_MAX", "bigint": "MIN_MAX", "smallint": "MIN_MAX", "date": "BLOOM_FILTER",
    "timestamp": "BLOOM_FILTER", "timestamp_ntz": "BLOOM_FILTER", "string": "BLOOM_FILTER", "struct": "BLOOM_FILTER",
}


@dataclass(frozen=True)
class Sketch:
    column: str
    kind: str
    limit: int = 100  # of a value set

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")

    def aggregates(self) -> list[Column]:
        c, name = F.col(self.column), self.column
        if self.kind == "PARTITION":
            return [F.min(c).alias(f"{name}__low"), F.max(c).alias(f"{name}__high")]  # one value, if the table is laid out by it
        if self.kind == "MIN_MAX":
            return [F.min(c).alias(f"{name}__min"), F.max(c).alias(f"{name}__max")]
        if self.kind == "VALUE_SET":
            values = F.collect_set(c)
            return [F.when(F.size(values) <= self.limit, values).alias(f"{name}__set")]
        return [F.bitmap_construct_agg(_bit(c, i)).alias(f"{name}__bits{i}") for i in range(_HASHES)]

    def may_hold(self, op: str, value: object) -> Column | None:
        """Whether a file can hold rows with ``column op value``; None if the sketch cannot tell."""
        name = self.column
        values = list(value) if op == "in" else [value]
        if any(v is None for v in values) or not values:
            return None
        if self.kind == "PARTITION" and op in ("=", "in"):
            return reduce(lambda a, b: a | b, [(F.col(f"{name}__low") <= F.lit(v)) & (F.col(f"{name}__high") >= F.lit(v)) for v in values])
        if self.kind == "VALUE_SET" and op in ("=", "in"):
            held = F.col(f"{name}__set")
            return held.isNull() | F.arrays_overlap(held, F.array(*map(F.lit, values)))
        if self.kind == "MIN_MAX":
            low, high = F.col(f"{name}__min"), F.col(f"{name}__max")
            if op == "=":
                return (low <= F.lit(value)) & (high >= F.lit(value))
            if op == "in":
                return (low <= F.lit(max(values))) & (high >= F.lit(min(values)))
            return {"<": low < F.lit(value), "<=": low <= F.lit(value), ">": high > F.lit(value), ">=": high >= F.lit(value)}.get(op)
        return None


def _of_kind(value: object, kind: str) -> bool:
    """Whether a filter compares the column with this value as they are: a value of another kind makes
    Spark cast the column, and then other stored values may equal it."""
    if isinstance(value, bool):
        return kind == "boolean"
    if isinstance(value, int):
        return kind in ("tinyint", "smallint", "int", "bigint", "double")
    if isinstance(value, str):
        return kind == "string"
    if isinstance(value, datetime.datetime):
        return kind.startswith("timestamp")
    return isinstance(value, float) and kind == "double" or isinstance(value, datetime.date) and kind == "date"


def _bit(c: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(i)), F.lit(_BITS)).cast("bigint")


def _bit_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0


def _at(name: str, probe: Column) -> Column:
    out = F.lit(True)
    for i in range(_HASHES):
        out = out & _bit_set(F.col(f"{name}__bits{i}"), _bit(probe, i))
    return out


def recommend(df: DataFrame, partitions: Sequence[str] = ()) -> dict[str, str]:
    """A kind for each column: PARTITION for partition columns, the others by their types."""
    out = {}
    for name, kind in df.dtypes:
        found = "PARTITION" if name in partitions else RECOMMENDED.get(kind.split("<")[0].split("(")[0])
        if found:
            out[name] = found
    return out


def build(df: DataFrame, columns: Mapping[str, str | tuple[str, int]]) -> DataFrame:
    """One row for each file of ``df`` (a table of files): its path and the sketches of the columns.

    Bitmaps alone would make Spark sort all rows of a task by path; with a set among the aggregates
    (of one constant, and asked for, so that it stays) it holds the sketches of a task's files instead.
    """
    sketches = _sketches(columns)
    one = F.collect_set(F.lit(True)).alias("__one")
    index = df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(*[a for s in sketches for a in s.aggregates()], one)
    return index.where(F.size("__one") == 1).drop("__one")


def _sketches(columns: Mapping[str, str | tuple[str, int]]) -> list[Sketch]:
    if not columns:
        raise ValueError("no column to index")
    return [Sketch(c, k) if isinstance(k, str) else Sketch(c, *k) for c, k in columns.items()]


def matching_files(index: DataFrame, columns: Mapping[str, str | tuple[str, int]], conditions: Sequence[tuple[str, str, object]], kinds: Mapping[str, str]) -> DataFrame:
    """Paths of files that can hold rows for which all conditions (column, operator, value) hold."""
    by = {s.column: s for s in _sketches(columns)}
    for column, op, value in conditions:
        if s := by.get(column):
            if s.kind == "BLOOM_FILTER" and op in ("=", "in"):
                values = list(value) if op == "in" else [value]
                keep = None
                if values and all(_of_kind(v, kinds[column]) for v in values):
                    keep = reduce(lambda a, b: a | b, [_at(column, F.lit(v).cast(kinds[column])) for v in values])
            else:
                keep = s.may_hold(op, value)
            if keep is not None:
                index = index.where(keep)
    return index.select("file_path")


def read(
    spark: SparkSession, path: str, index: DataFrame, columns: Mapping[str, str | tuple[str, int]],
    conditions: Sequence[tuple[str, str, object]],
) -> DataFrame:
    """Rows of the parquet table at ``path`` that meet the conditions, from as few files as the index allows.

    Columns that the table's folders hold keep their values. Files that the index does not know are
    read, too; one that is written anew under its old path has to be indexed again. Only the paths of files to read come to the
    driver, where Spark plans a scan anyway.
    """
    table = spark.read.parquet(path)
    known = {r[0] for r in index.select("file_path").collect()}
    wanted = {r[0] for r in matching_files(index, columns, conditions, dict(table.dtypes)).collect()}
    plain = lambda p: p.replace("file:///", "file:/")
    known, wanted = set(map(plain, known)), set(map(plain, wanted))
    files = [f for f in table.inputFiles() if plain(f) in wanted or plain(f) not in known]
    out = spark.read.schema(table.schema).option("basePath", path).parquet(*files) if files else table.limit(0)
    for column, op, value in conditions:
        c = F.col(column)
        out = out.where(c.isin(list(value)) if op == "in" else {"=": c == F.lit(value), "<": c < F.lit(value), "<=": c <= F.lit(value), ">": c > F.lit(value), ">=": c >= F.lit(value)}[op])
    return out
