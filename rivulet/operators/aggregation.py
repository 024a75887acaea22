"""Aggregation: groups with numeric and time buckets, statistics on every row, frequent and rare values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators._cols import Expr, Step, expr, field, fresh, name_of, names, quoted

#: The units of a time bucket; m is minute and M is month.
UNITS = {
    "ms": "millisecond", "millisecond": "millisecond", "milliseconds": "millisecond",
    "s": "second", "sec": "second", "second": "second", "seconds": "second",
    "m": "minute", "min": "minute", "minute": "minute", "minutes": "minute",
    "h": "hour", "hr": "hour", "hour": "hour", "hours": "hour",
    "d": "day", "day": "day", "days": "day",
    "w": "week", "week": "week", "weeks": "week",
    "M": "month", "month": "month", "months": "month",
    "q": "quarter", "quarter": "quarter", "quarters": "quarter",
    "y": "year", "year": "year", "years": "year",
}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


@dataclass(frozen=True)
class Span:
    """A bucket of ``n`` (units) of a field."""

    field: Expr
    n: float
    unit: str | None = None
    alias: str | None = None

    def column(self) -> Column:
        """Numbers: the bucket's lower end. Times: a struct of start and end.

        Buckets up to weeks are counted from 1970-01-01 (weeks start on Thursday); months,
        quarters and years are calendar periods.
        """
        f = field(self.field)
        name = self.alias or f"span({name_of(self.field)},{self.n:g}{self.unit or ''})"
        if self.n <= 0:
            raise ValueError("a span must be positive")
        if self.unit is None:
            return (F.floor(f / F.lit(self.n)) * F.lit(self.n)).alias(name)
        unit = UNITS.get(self.unit) or UNITS.get(self.unit.lower())
        if unit is None:
            raise ValueError(f"unknown unit {self.unit!r}")
        if unit in _MONTHS:
            size = int(self.n) * _MONTHS[unit]
            month = F.year(f) * 12 + F.month(f) - 1
            first = F.floor(month / F.lit(size)) * size

            def day(months: Column) -> Column:
                return F.make_date(F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")

            return F.when(f.isNotNull(), F.struct(day(first).alias("start"), day(first + size).alias("end"))).alias(name)
        return F.window(f, f"{int(self.n)} {unit}").alias(name)


def span(column: Expr, n: float, unit: str | None = None, alias: str | None = None) -> Span:
    return Span(column, n, unit, alias)


# Aggregate functions, as columns. ``stddev`` is the population's, as ``std``.
def count(x: Expr | None = None) -> Column:
    return F.count("*").alias("count()") if x is None else F.count(field(x)).alias(f"count({name_of(x)})")


def distinct_count(x: Expr) -> Column:
    return F.count_distinct(field(x)).alias(f"distinct_count({name_of(x)})")


def distinct_count_approx(x: Expr) -> Column:
    return F.approx_count_distinct(field(x)).alias(f"distinct_count_approx({name_of(x)})")


def _simple(name: str, f):  # noqa: ANN001, ANN202
    def made(x: Expr) -> Column:
        return f(expr(x)).alias(f"{name}({name_of(x)})")

    made.__name__ = name
    return made


sum_ = _simple("sum", F.sum)
avg = _simple("avg", F.avg)
mean = _simple("mean", F.avg)
min_ = _simple("min", F.min)
max_ = _simple("max", F.max)
stddev = _simple("stddev", F.stddev_pop)
std = _simple("std", F.stddev_pop)
stddev_pop = _simple("stddev_pop", F.stddev_pop)
stddev_samp = _simple("stddev_samp", F.stddev_samp)
var_pop = _simple("var_pop", F.var_pop)
variance = _simple("variance", F.var_pop)
var_samp = _simple("var_samp", F.var_samp)


def _share(p: int) -> float:
    if not isinstance(p, int) or not 0 <= p <= 100:
        raise ValueError("a percentile must be an integer from 0 to 100")
    return p / 100


def percentile(x: Expr, p: int) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(expr(x), _share(p)).alias(f"percentile({name_of(x)}, {p})")


def percentile_approx(x: Expr, p: int) -> Column:
    """One of the values, from a bounded sketch."""
    return F.percentile_approx(expr(x), _share(p)).alias(f"percentile_approx({name_of(x)}, {p})")


def stats(*aggregates: Column, by: Sequence[Expr | Span] | Expr | Span = ()) -> Step:
    """Groups and aggregates: columns are the aggregates, then the group fields, then the span.

    Null keys form a group. Without ``by`` there is one row.
    """
    keys = list(by) if isinstance(by, (list, tuple)) else [by]
    spans = [k for k in keys if isinstance(k, Span)]
    if len(spans) > 1:
        raise ValueError("one span at most")
    if not aggregates:
        raise ValueError("no aggregate")

    def step(df: DataFrame) -> DataFrame:
        plain = [field(k) for k in keys if not isinstance(k, Span)]
        columns = plain + [s.column() for s in spans]
        if not columns:
            return df.agg(*aggregates)
        out = df.groupBy(*columns).agg(*aggregates)
        cut = len(columns)
        return out.select(*[F.col(quoted(c)) for c in out.columns[cut:] + out.columns[:cut]])

    return step


def take(column: str, n: int = 10, by: str | list[str] = (), alias: str | None = None) -> Step:
    """The ``n`` smallest non-null values of each group, in order, as an array.

    Spark keeps ``n`` rows of a group on the map side already, so no group is gathered.
    """
    groups = names(by)

    def step(df: DataFrame) -> DataFrame:
        order = Window.partitionBy(*map(field, groups)).orderBy(field(column))
        rank = fresh(df, "__rank")
        few = df.where(field(column).isNotNull()).withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)
        values = F.array_sort(F.collect_list(field(column))).alias(alias or f"take({column}, {n})")
        out = few.groupBy(*groups).agg(values)
        return out.select(*out.columns[len(groups):], *groups)

    return step


def eventstats(*aggregates: Column, by: Sequence[Expr | Span] | Expr | Span = ()) -> Step:
    """The group's aggregates on every row, behind its other columns.

    Aggregates are computed by group (with partial sums on the map side) and joined back, so a key
    with very many rows is not sorted in one task, and distinct counts work. Without ``by`` the one
    row of aggregates is broadcast.
    """
    keys = list(by) if isinstance(by, (list, tuple)) else [by]

    def step(df: DataFrame) -> DataFrame:
        if not keys:
            return df.crossJoin(F.broadcast(df.agg(*aggregates)))
        parts = [(k.column() if isinstance(k, Span) else field(k)) for k in keys]
        stems = [fresh(df, f"__k{i}") for i in range(len(parts))]
        left = df
        for stem, part in zip(stems, parts, strict=True):
            left = left.withColumn(stem, part)
        groups = left.groupBy(*stems).agg(*aggregates)
        groups = groups.select(*[F.col(s).alias(f"{s}_r") for s in stems], *[F.col(quoted(c)) for c in groups.columns[len(stems):]])
        same = None
        for s in stems:
            one = F.col(s).eqNullSafe(F.col(f"{s}_r"))
            same = one if same is None else same & one
        return left.join(groups, same).drop(*stems, *[f"{s}_r" for s in stems])

    return step


def _frequent(columns: str | list[str], by: str | list[str], n: int | None, *, descending: bool, count_name: str | None) -> Step:
    what, groups = names(columns), names(by)

    def step(df: DataFrame) -> DataFrame:
        name = count_name or f"count_{what[0]}"
        out = df.groupBy(*what, *groups).agg(F.count(field(what[0])).alias(name))
        order = F.col(quoted(name)).desc_nulls_last() if descending else F.col(quoted(name)).asc_nulls_first()
        keys = [*what, *groups]
        out = out.orderBy(order, *[F.col(k).asc_nulls_first() for k in keys]).select(F.col(quoted(name)), *keys)
        return out if n is None else out.limit(n)

    return step


def top(columns: str | list[str], n: int | None = None, by: str | list[str] = (), count_name: str | None = None) -> Step:
    """Most frequent combinations, over all groups together; ties by value; all of them without ``n``."""
    return _frequent(columns, by, n, descending=True, count_name=count_name)


def rare(columns: str | list[str], n: int | None = None, by: str | list[str] = (), count_name: str | None = None) -> Step:
    return _frequent(columns, by, n, descending=False, count_name=count_name)


def _approximate(columns: str | list[str], by: str | list[str], n: int | None, *, descending: bool) -> Step:
    def step(df: DataFrame) -> DataFrame:
        return _frequent(columns, by, n, descending=descending, count_name=None)(df)

    return step


def top_approx(columns: str | list[str], n: int | None = None, by: str | list[str] = ()) -> Step:
    """As :func:`top`: partial counts on the map side make exact counts as cheap as estimates here."""
    return _approximate(columns, by, n, descending=True)


def rare_approx(columns: str | list[str], n: int | None = None, by: str | list[str] = ()) -> Step:
    return _approximate(columns, by, n, descending=False)


def dedup(columns: str | list[str], n: int = 1, *, keepempty: bool = False, consecutive: bool = False, order: Sequence[Expr] = ()) -> Step:
    """At most ``n`` rows of each combination; rows with a null key go, or all stay with ``keepempty``.

    ``order`` says which rows stay (``"-x"`` as in sort); else it is any of them. For one row
    without an order Spark aggregates before it shuffles; otherwise rows are numbered by key.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    if consecutive:
        raise ValueError("consecutive duplicates are not supported: rows of a table have no order")
    keys = names(columns)

    def step(df: DataFrame) -> DataFrame:
        from rivulet.operators._cols import sort_keys

        null = None
        for k in keys:
            null = field(k).isNull() if null is None else null | field(k).isNull()
        full = df.where(~null)
        if n == 1 and not order and all(k in df.columns for k in keys):
            out = full.dropDuplicates(keys)
        else:
            rank = fresh(df, "__rank")
            by = Window.partitionBy(*map(field, keys)).orderBy(*(sort_keys(order) or map(field, keys)))
            out = full.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= n).drop(rank)
        return out.unionByName(df.where(null)) if keepempty else out

    return step
