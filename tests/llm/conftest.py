import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, near copies, personal data."""
    base = "the quick brown fox jumps over a lazy dog while nine old cats sleep under the warm red roof of our barn and dream of mice"
    near = base.replace("nine", "ten") + " " + " ".join(f"tail{i}" for i in range(40))
    other = base + " " + " ".join(f"tail{i}" for i in range(40))
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, near, "en", "b", 5), (6, other, "de", "b", 5), (7, "x " * 30000, "fr", "c", 1), (None, base, "en", "c", 1), (8, "one two", "es", "d", 2), (9, "One  TWO", "es", "d", 2), (10, "mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111, +1 (499) 555-6503", "en", "d", 3), (11, "\n \t", "en", "e", 1), (12, "a b c a b c a b c\na b c a b c a b c\n", "en", "e", 1)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 13)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
