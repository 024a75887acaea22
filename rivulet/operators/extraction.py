"""Fields from text: regular expressions with named groups, grok patterns, and what is left without letters and digits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators._cols import Expr, Step, field
from rivulet.operators.grok_patterns import PATTERNS

_REFERENCE = re.compile(r"%\{(\w+)(?:=((?:[^{}]|\{[^{}]*\})*))?(?::([\w.\[\]-]+))?(?:;[^}]*)?\}")
_SKIPPED = "UNWANTED"


def group_numbers(pattern: str) -> dict[str, int]:
    """Numbers of the named groups of a Java regular expression; unnamed groups count, too."""
    out: dict[str, int] = {}
    n, i, in_class = 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern.startswith("\\Q", i):
                end = pattern.find("\\E", i)
                i = len(pattern) if end < 0 else end
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif c == "(" and not in_class:
            if named := re.match(r"\(\?<([a-zA-Z][a-zA-Z0-9]*)>", pattern[i:]):
                n += 1
                out[named[1]] = n
            elif not pattern.startswith("(?", i):
                n += 1
        i += 1
    return out


def parse(column: Expr, pattern: str) -> Step:
    """One string column for each named group: empty where nothing matches, null for null."""
    groups = group_numbers(pattern)
    if not groups:
        raise ValueError("the pattern has no named group")

    def step(df: DataFrame) -> DataFrame:
        source = field(column)
        return df.withColumns({name: F.regexp_extract(source, pattern, n) for name, n in groups.items()})

    return step


def compile_grok(pattern: str, more: dict[str, str] | None = None) -> tuple[str, dict[str, int]]:
    """A Java regular expression and the group number of each field.

    ``%{NAME}`` gives a field called NAME, ``%{NAME:field}`` one called field; UNWANTED gives none.
    ``%{NAME=regex}`` defines a pattern on the spot. A field that occurs again keeps its first group.
    """
    known = {**PATTERNS, **(more or {})}
    fields: list[str] = []

    def expand(text: str, depth: int) -> str:
        if depth > 100:
            raise ValueError("grok patterns refer to each other in a circle")

        def one(m: re.Match) -> str:
            name, inline, alias = m.groups()
            if inline is not None:
                known[name] = inline
            if name not in known:
                raise ValueError(f"unknown grok pattern {name!r}")
            number = len(fields)
            fields.append(alias or name)
            return f"(?<g{number}>{expand(known[name], depth + 1)})"

        return _REFERENCE.sub(one, text)

    regex = expand(pattern, 0)
    numbers = group_numbers(regex)
    out: dict[str, int] = {}
    for i, name in enumerate(fields):
        if name != _SKIPPED:
            out.setdefault(name, numbers[f"g{i}"])
    return regex, out


def grok(column: Expr, pattern: str, more: dict[str, str] | None = None) -> Step:
    """Fields of a grok pattern as string columns; the pattern is expanded once, on the driver."""
    regex, groups = compile_grok(pattern, more)

    def step(df: DataFrame) -> DataFrame:
        source = field(column)
        return df.withColumns({name: F.regexp_extract(source, regex, n) for name, n in groups.items()})

    return step


def patterns(column: Expr, new_field: str = "patterns_field", pattern: str = "[a-zA-Z0-9]") -> Step:
    """What is left of a text when all that matches the pattern is taken away."""
    return lambda df: df.withColumn(new_field, F.regexp_replace(field(column), pattern, ""))
