"""Sources, filters, projections, ordering and limits."""

from __future__ import annotations

import contextlib
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators._cols import Expr, Step, expr, field, fresh, move_last, names, quoted, sort_keys


def pipe(df: DataFrame, *steps: Step) -> DataFrame:
    """Apply steps in order: ``pipe(orders, where("o_totalprice > 10"), head(5))``."""
    return reduce(lambda x, step: x.transform(step), steps, df)


def source(spark: SparkSession, *tables: str | DataFrame, alias: str | None = None) -> DataFrame:
    """One or several tables; several are united by column name, and columns that one lacks are null.

    Later steps see the union, so aggregates and limits hold for all tables together.
    """
    frames = [t if isinstance(t, DataFrame) else spark.table(t) for t in tables]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return df.alias(alias) if alias else df


def where(*conditions: Expr) -> Step:
    """Rows for which all conditions hold."""
    return lambda df: df.where(reduce(lambda a, b: a & b, map(expr, conditions)))


def fields(*columns: Expr) -> Step:
    """Projection in the order given."""
    return lambda df: df.select(*map(field, columns))


def fields_except(*columns: str) -> Step:
    """All columns but these; names that are not there are an error."""

    def step(df: DataFrame) -> DataFrame:
        known = {c.lower() for c in df.columns}
        if missing := [c for c in columns if c.lower() not in known]:
            raise ValueError(f"no such columns: {missing}")
        return df.drop(*columns)

    return step


def evaluate(**assignments: Expr) -> Step:
    """Add columns; later ones may use earlier ones, and an existing name is replaced in place."""

    def step(df: DataFrame) -> DataFrame:
        for name, e in assignments.items():
            df = df.withColumn(name, expr(e))
        return df

    return step


def rename(**new_by_old: str) -> Step:
    """``rename(old="new")``: renamed columns move to the end."""

    def step(df: DataFrame) -> DataFrame:
        return move_last(df, {new: F.col(quoted(old)) for old, new in new_by_old.items()}, list(new_by_old))

    return step


def sort(*keys: Expr) -> Step:
    """Global order: ``"+x"`` nulls first, ``"-x"`` nulls last. With :func:`head` Spark keeps only the top rows."""
    return lambda df: df.orderBy(*sort_keys(keys))


def head(n: int = 10, offset: int = 0) -> Step:
    if n < 0 or offset < 0:
        raise ValueError("n and offset must not be negative")
    return lambda df: (df.offset(offset) if offset else df).limit(n)


def fillnull(value: Expr | int | float | None = None, columns: str | list[str] = (), **by_column: Expr | int | float) -> Step:
    """``fillnull(0, ["a", "b"])`` or ``fillnull(a=0, b="c")``: nulls replaced, columns moved to the end."""
    values = {c: value for c in names(columns)} | by_column
    if not values:
        raise ValueError("no columns to fill")
    return lambda df: move_last(df, {c: F.coalesce(F.col(quoted(c)), expr(v)) for c, v in values.items()})


def describe(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE EXTENDED {table}")


def explain(df: DataFrame, mode: str = "simple") -> str:
    """Plan text: simple, extended, codegen, cost or formatted."""
    if mode not in ("simple", "extended", "codegen", "cost", "formatted"):
        raise ValueError(f"unknown mode {mode!r}")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def exists_in(other: DataFrame, on: Expr | list[str], *, negate: bool = False) -> Step:
    """``[not] exists``: rows with (without) a partner in ``other``, as a semi (anti) join.

    ``on`` is a condition on both sides, which may be aliased, or column names they share.
    """
    condition = on if isinstance(on, list) else expr(on)
    return lambda df: df.join(other, condition, "left_anti" if negate else "left_semi")


def in_subsearch(columns: str | list[str], other: DataFrame, *, negate: bool = False) -> Step:
    """``(a, b) [not] in [subsearch]`` with SQL's null rules.

    ``not in`` keeps a row only if the comparison is false for every row of ``other``: a null key
    that could match makes it unknown, and the row goes; nothing goes if ``other`` is empty.
    """
    keys = names(columns)

    def step(df: DataFrame) -> DataFrame:
        at = [fresh(df, f"__r{i}") for i in range(len(other.columns))]
        right = other.select(*[F.col(quoted(c)).alias(r) for c, r in zip(other.columns, at, strict=True)]).distinct()
        if len(at) != len(keys):
            raise ValueError("the subsearch must have as many columns as are compared")
        equal = [field(k) == F.col(r) for k, r in zip(keys, at, strict=True)]
        if not negate:
            return df.join(right, reduce(lambda a, b: a & b, equal), "left_semi")
        if len(keys) == 1:
            n, k = fresh(df, "__n"), fresh(df, "__k")
            facts = other.agg(F.count("*").alias(n), F.count(other.columns[0]).alias(k))  # one row
            kept = df.crossJoin(F.broadcast(facts)).where((F.col(n) == 0) | (field(keys[0]).isNotNull() & (F.col(n) == F.col(k))))
            return kept.drop(n, k).join(right, equal[0], "left_anti")
        return _without_possible_partners(df, keys, right, at)

    return step


def _without_possible_partners(df: DataFrame, keys: list[str], right: DataFrame, at: list[str]) -> DataFrame:
    """Rows of ``df`` that no row of ``right`` equals where neither side is null.

    Which keys are null on the right is a pattern; for each pattern one anti join by equality: the
    keys that both sides have must be equal, and which keys the left side has must be the same.
    """
    mask = lambda cs: sum((F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cs)), F.lit(0))
    left = [field(k) for k in keys]
    every, which = 1 << len(keys), fresh(df, "__left")
    for pattern in range(every):
        has = [pattern >> i & 1 for i in range(len(keys))]
        some = right.where(mask([F.col(r) for r in at]) == pattern).withColumn(which, F.explode(F.array(*map(F.lit, range(every)))))
        some = some.select(which, *[F.when(F.col(which).bitwiseAND(1 << i) != 0, F.col(r)).alias(r) if has[i] else F.lit(None).cast("string").alias(r) for i, r in enumerate(at)]).distinct()
        same = mask(left) == F.col(which)
        for i, (c, r) in enumerate(zip(left, at, strict=True)):
            if has[i]:
                same = same & c.eqNullSafe(F.col(r))
        df = df.join(some, same, "left_anti")
    return df


def with_scalar(name: str, other: DataFrame) -> Step:
    """Add the single value of ``other`` (one aggregate row) as a column; null if it has no row."""
    return lambda df: df.withColumn(name, other.scalar())


def if_(condition: Expr, yes: Expr, no: Expr) -> Column:
    return F.when(expr(condition), expr(yes)).otherwise(expr(no))


def case(*pairs: tuple[Expr, Expr | int | float], default: Expr | int | float | None = None) -> Column:
    """``case((c1, v1), (c2, v2), default=v)``: null if nothing holds and there is no default."""
    out: Column | None = None
    for c, v in pairs:
        out = F.when(expr(c), expr(v)) if out is None else out.when(expr(c), expr(v))
    return out.otherwise(expr(default)) if default is not None else out


