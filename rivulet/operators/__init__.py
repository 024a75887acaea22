"""Operators: each makes a step from DataFrame to DataFrame for ``df.transform`` or :func:`pipe`."""

from rivulet.operators.aggregation import (
    Span,
    avg,
    count,
    dedup,
    distinct_count,
    distinct_count_approx,
    eventstats,
    max_,
    mean,
    min_,
    percentile,
    percentile_approx,
    rare,
    rare_approx,
    span,
    stats,
    std,
    stddev,
    stddev_pop,
    stddev_samp,
    sum_,
    take,
    top,
    top_approx,
    var_pop,
    var_samp,
    variance,
)
from rivulet.operators.extraction import grok, parse, patterns
from rivulet.operators.joins import correlate, geoip, join, lookup, self_correlate
from rivulet.operators.nested import expand, flatten
from rivulet.operators.relational import (
    case,
    describe,
    evaluate,
    exists_in,
    explain,
    fields,
    fields_except,
    fillnull,
    head,
    if_,
    in_subsearch,
    pipe,
    rename,
    sort,
    source,
    where,
    with_scalar,
)
from rivulet.operators.windows import appendcol, fieldsummary, numbered, sma, trendline, wma

__all__ = [
    "Span", "appendcol", "avg", "case", "correlate", "count", "dedup", "describe", "distinct_count", "distinct_count_approx",
    "evaluate", "eventstats", "exists_in", "expand", "explain", "fields", "fields_except", "fieldsummary", "fillnull", "flatten",
    "geoip", "grok", "head", "if_", "in_subsearch", "join", "lookup", "max_", "mean", "min_", "numbered", "parse", "patterns",
    "percentile", "percentile_approx", "pipe", "rare", "rare_approx", "rename", "self_correlate", "sma", "sort", "source", "span",
    "stats", "std", "stddev", "stddev_pop", "stddev_samp", "sum_", "take", "top", "top_approx", "trendline", "var_pop", "var_samp",
    "variance", "where", "with_scalar", "wma",
]
