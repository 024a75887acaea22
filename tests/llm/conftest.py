import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, ties, and clashing further columns."""
    long = " ".join(f"word{i % 700} and" for i in range(9000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 60), (2, None, None, None, None), (3, "", "en", "a", 0),
        (4, long, "en", "b", len(long)), (5, long, "en", "a", len(long)), (5, long, "en", "a", len(long)), (None, "No id here at all, really none.", "en", "b", 10),
        (None, None, "fr", None, 0), (7, "42 !!! ???", "fr", "c", 9), (8, "Le renard brun saute par dessus le chien.", "fr", "c", 40),
    ]
    return spark.createDataFrame([(*r, "x", 0.5, "und", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, epochs string, score double, lang_pred string, predicted int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
