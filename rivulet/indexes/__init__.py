"""Derived tables that make queries cheaper: file-skipping indexes, covering indexes and materialised views."""
