"""Named queries over the given tables, one for each operator, and their SQL equivalents."""

from rivulet.plans import aggregates, derived, functions, joined, relational, text  # noqa: F401
from rivulet.plans._registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
