"""JSON in text columns. Reading is Spark's own; edits go through Arrow in batches."""

from __future__ import annotations

import json as codec
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rivulet.functions._args import col, value
from rivulet.shipping import ship

to_json_string = F.to_json
json_array_length = F.json_array_length


def json(x: Column | str) -> Column:
    """The text if it is valid JSON, else null."""
    return F.get_json_object(col(x), "$")


def json_valid(x: Column | str) -> Column:
    return F.get_json_object(col(x), "$").isNotNull()


def json_extract(x: Column | str, path: str) -> Column:
    return F.get_json_object(col(x), path)


def json_keys(x: Column | str) -> Column:
    """Names of the outer object; null if it is none."""
    return F.json_object_keys(col(x))


def json_object(*pairs: object) -> Column:
    """A struct from names and values in turn."""
    if len(pairs) % 2:
        raise ValueError("names and values in pairs")
    return F.struct(*[value(v).alias(str(k)) for k, v in zip(pairs[::2], pairs[1::2], strict=True)])


def json_array(*values: object) -> Column:
    return F.array(*map(value, values))


def _parents(node: object, path: list[str], *, make: bool) -> Iterator[dict]:
    """The objects that hold the last name of a path; lists on the way are followed into every element."""
    if isinstance(node, list):
        for x in node:
            yield from _parents(x, path, make=make)
    elif isinstance(node, dict):
        if len(path) == 1:
            yield node
        else:
            if make and path[0] not in node:
                node[path[0]] = {}
            if path[0] in node:
                yield from _parents(node[path[0]], path[1:], make=make)


def _read(text: str) -> object:
    try:
        return codec.loads(text)
    except ValueError:
        return text


def edit_delete(doc: dict, args: list[str]) -> None:
    for path in args:
        for parent in list(_parents(doc, path.split("."), make=False)):
            parent.pop(path.split(".")[-1], None)


def edit_set(doc: dict, args: list[str]) -> None:
    for path, new in zip(args[::2], args[1::2], strict=False):
        for parent in list(_parents(doc, path.split("."), make=True)):
            parent[path.split(".")[-1]] = _read(new)


def _lists(doc: dict, args: list[str]) -> Iterator[tuple[list, object]]:
    for path, new in zip(args[::2], args[1::2], strict=False):
        for parent in list(_parents(doc, path.split("."), make=True)):
            target = parent.setdefault(path.split(".")[-1], [])
            if isinstance(target, list):
                yield target, _read(new)


def edit_append(doc: dict, args: list[str]) -> None:
    for target, new in _lists(doc, args):
        target.append(new)


def edit_extend(doc: dict, args: list[str]) -> None:
    for target, new in _lists(doc, args):
        target.extend(new if isinstance(new, list) else [new])


def edited(text: str | None, args: list[str] | None, edit: Callable[[dict, list[str]], None]) -> str | None:
    """The edited object as JSON; null for null and for anything that is no JSON object."""
    if text is None or args is None:
        return None
    try:
        doc = codec.loads(text)
    except ValueError:
        return None
    if not isinstance(doc, dict):
        return None
    edit(doc, list(args))
    return codec.dumps(doc, separators=(",", ":"), ensure_ascii=False)


def _udf(edit: Callable[[dict, list[str]], None]) -> Callable[[Column, Column], Column]:
    def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, args in parts:
            yield pd.Series([edited(t, a, edit) for t, a in zip(texts, args, strict=True)], dtype=object)

    batches.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "string")


def _applied(edit: Callable[[dict, list[str]], None], x: Column | str, args: tuple[object, ...]) -> Column:
    ship(SparkSession.getActiveSession())
    items = F.array(*[value(a).cast("string") for a in args]) if args else F.array().cast("array<string>")
    return _udf(edit)(col(x), items)


def json_delete(x: Column | str, *paths: str) -> Column:
    """Without the values at dotted paths; paths that are not there do nothing."""
    return _applied(edit_delete, x, paths)


def json_set(x: Column | str, *paths_and_values: object) -> Column:
    """With values (JSON, or else text) at dotted paths; objects on the way are made."""
    return _applied(edit_set, x, paths_and_values)


def json_append(x: Column | str, *paths_and_values: object) -> Column:
    """With a value behind the list at a path; the list is made if it is not there."""
    return _applied(edit_append, x, paths_and_values)


def json_extend(x: Column | str, *paths_and_values: object) -> Column:
    """As append, but the elements of a list go in one by one."""
    return _applied(edit_extend, x, paths_and_values)
