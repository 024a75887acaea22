"""Operators over ordered rows: moving averages, and columns set beside each other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators._cols import Expr, Step, field, fresh, name_of, quoted, sort_keys
from rivulet.scratch import save

_PIECE = 250_000  # rows


@dataclass(frozen=True)
class Trend:
    kind: str
    n: int
    column: Expr
    alias: str | None = None

    def __post_init__(self) -> None:
        if self.n < 1:
            raise ValueError("n must be at least 1")


def sma(n: int, column: Expr, alias: str | None = None) -> Trend:
    """Mean of the last ``n`` rows; null before there are so many."""
    return Trend("sma", n, column, alias)


def wma(n: int, column: Expr, alias: str | None = None) -> Trend:
    """Mean of the last ``n`` rows with weights 1 to ``n``, the latest weighing most."""
    return Trend("wma", n, column, alias)


def trendline(*trends: Trend, sort: Sequence[Expr] = (), by: Sequence[Expr] = ()) -> Step:
    """Moving averages in the order of ``sort``, over the whole table or (``by``, an extension) in each group.

    A frame over the whole table is not one task: rows are numbered in order, cut into pieces, and
    each piece gets the few rows before it that its first frames reach.
    """
    if not sort and any(t.kind == "wma" for t in trends):
        raise ValueError("a weighted average needs an order")
    if by and not sort:
        raise ValueError("averages in groups need an order")
    reach = max(t.n for t in trends) - 1

    def step(df: DataFrame) -> DataFrame:
        row, piece, within = (fresh(df, n) for n in ("__row", "__piece", "__in"))
        if by:
            base, rows = Window.partitionBy(*map(field, by)).orderBy(*sort_keys(sort)), df
        else:
            rows = numbered(df, sort, row).withColumn(piece, F.floor((F.col(row) - 1) / _PIECE))
            reached = F.floor((F.col(row) - 1 + reach) / _PIECE)  # the last piece whose frames look back on the row
            rows = rows.withColumn(within, F.explode(F.sequence(F.col(piece), reached)))
            base = Window.partitionBy(within).orderBy(row)
        new = {}
        for t in trends:
            frame = base.rowsBetween(1 - t.n, 0)
            full = F.count(F.lit(1)).over(frame) >= t.n
            if t.kind == "sma":
                value = F.avg(field(t.column)).over(frame)
            else:
                value = sum((F.nth_value(field(t.column), i + 1).over(frame) * (i + 1) for i in range(t.n)), F.lit(0)) / (t.n * (t.n + 1) / 2)
            new[t.alias or f"{name_of(t.column)}_trendline"] = F.when(full, value)
        out = rows.withColumns(new)
        return out if by else out.where(F.col(within) == F.col(piece)).drop(within, piece, row)

    return step


def numbered(df: DataFrame, order: Sequence[Expr], name: str) -> DataFrame:
    """Row numbers from 1 in a global order, without one task that sees all rows.

    Rows are sorted by ranges of the keys and written once with their partition and their place in
    it; each partition is counted, and its rows are numbered from the sum of the counts before it.
    """
    part, place, mine, before, n, p = (fresh(df, x) for x in ("__part", "__place", "__id", "__before", "__n", "__p"))
    ranged = df.repartitionByRange(*sort_keys(order)).sortWithinPartitions(*sort_keys(order)) if order else df
    marked = ranged.withColumn(mine, F.monotonically_increasing_id())
    marked = marked.withColumn(part, F.shiftright(mine, 33)).withColumn(place, F.col(mine).bitwiseAND((1 << 33) - 1)).drop(mine)
    marked = save(marked, "numbered")
    counts = marked.groupBy(part).agg((F.max(place) + 1).alias(n))  # one row for each partition
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(part).alias(p), F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(before))
    out = marked.join(F.broadcast(starts), F.col(part) == F.col(p))
    return out.withColumn(name, F.col(before) + F.col(place) + 1).drop(part, place, p, before)


def appendcol(sub: Callable[[DataFrame], DataFrame], *, override: bool = False, order: Sequence[Expr] = (), sub_order: Sequence[Expr] = ()) -> Step:
    """Set the columns of a sub-search over the same source beside the rows, by row number.

    Rows are numbered in the order given (else as they come); the shorter side is filled with
    nulls. With ``override`` the sub-search's columns replace those so named.
    """

    def step(df: DataFrame) -> DataFrame:
        right = sub(df)
        one, two = fresh(df, "__n1"), fresh(right, "__n2")
        a = numbered(df, order, one)
        b = numbered(right, sub_order, two)
        taken = {c.lower() for c in right.columns} if override else set()
        left_columns = [c for c in df.columns if c.lower() not in taken]
        a = a.select(F.col(one).alias("__n1"), *[F.col(quoted(c)).alias(f"__a{i}") for i, c in enumerate(left_columns)])
        b = b.select(F.col(two).alias("__n2"), *[F.col(quoted(c)).alias(f"__b{i}") for i, c in enumerate(right.columns)])
        return a.join(b, F.col("__n1") == F.col("__n2"), "full").select(
            *[F.col(f"__a{i}").alias(c) for i, c in enumerate(left_columns)],
            *[F.col(f"__b{i}").alias(c) for i, c in enumerate(right.columns)],
        )

    return step


def fieldsummary(columns: Sequence[str] = (), *, nulls: bool = False) -> Step:
    """One row of statistics for each field, from one pass over the table.

    ``nulls``: means and deviation count nulls as 0. Texts have no mean. An empty table gives no rows.
    """

    def step(df: DataFrame) -> DataFrame:
        wanted = list(columns) or df.columns
        kinds = dict(df.dtypes)
        parts = []
        for c in wanted:
            f = F.col(quoted(c))
            number = f.cast("double") if kinds[c] not in ("string", "boolean", "date") and not kinds[c].startswith(("timestamp", "array", "struct", "map", "binary")) else F.lit(None).cast("double")
            value = F.coalesce(number, F.lit(0.0)) if nulls and number is not None else number
            parts.append(
                F.struct(
                    F.lit(c).alias("Field"), F.count(f).alias("COUNT"), F.count_distinct(f).alias("DISTINCT"),
                    F.min(f).cast("string").alias("MIN"), F.max(f).cast("string").alias("MAX"),
                    F.avg(value).alias("AVG"), F.avg(value).alias("MEAN"), F.stddev(value).alias("STDDEV"),
                    (F.count("*") - F.count(f)).alias("Nulls"), F.lit(kinds[c]).alias("TYPEOF"),
                )
            )
        total = df.agg(F.count("*").alias("__rows"), *[p.alias(f"__f{i}") for i, p in enumerate(parts)]).where("__rows > 0")
        return total.select(F.explode(F.array(*[F.col(f"__f{i}") for i in range(len(parts))])).alias("__s")).select("__s.*")

    return step


