"""Queries with SQL against DuckDB, and all queries for rows and names."""

import pytest
from oracle import assert_same, duck

from rivulet.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize(("name", "table"), [("op3_fingerprint", "documents"), ("op4_toxicity", "documents"), ("op5_language_id", "documents"), ("op6_html_extract", "pages"), ("op9_near_duplicates", "documents")])
def test_one_row_for_each_input_row(spark, sf_dir, name, table):
    assert QUERIES[name](spark, sf_dir).count() == duck(f"SELECT count(*) FROM {table}", sf_dir)[1][0][0]
