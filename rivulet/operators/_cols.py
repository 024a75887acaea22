"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]
Expr = Column | str


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def expr(e: Expr | int | float | bool | None) -> Column:
    """A column from a Column, a SQL expression, or a plain value."""
    if isinstance(e, Column):
        return e
    return F.expr(e) if isinstance(e, str) else F.lit(e)


def field(name: Expr) -> Column:
    """A column by its name (dots descend into structs)."""
    return name if isinstance(name, Column) else F.col(name)


def name_of(c: Expr) -> str:
    """The output name of a column; of a struct field its last part."""
    if isinstance(c, Column):
        return str(c).removeprefix("Column<'").removesuffix("'>")
    return c.split(".")[-1].strip("`")


def names(fields: str | Sequence[str]) -> list[str]:
    return [fields] if isinstance(fields, str) else list(fields)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def move_last(df: DataFrame, new: dict[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """Replace columns and set them behind all others."""
    gone = {c.lower() for c in [*new, *drop]}
    kept = [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def sort_keys(keys: Sequence[Expr]) -> list[Column]:
    """``"x"`` or ``"+x"`` ascending with nulls first, ``"-x"`` descending with nulls last."""
    out = []
    for k in keys:
        if isinstance(k, Column):
            out.append(k)
        elif k.strip().startswith("-"):
            out.append(F.col(k.strip()[1:].strip()).desc_nulls_last())
        else:
            out.append(F.col(k.strip().lstrip("+").strip()).asc_nulls_first())
    return out
