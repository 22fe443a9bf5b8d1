import os
import sys

import pytest
from texts import prose

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, schema=DOCS):
        full = [tuple(r) + (None,) * (len(schema.split(",")) - len(r)) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in every column, empty and blank texts, repeated rows, one very long text."""
    return [
        (None, None, None, None, None),
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", 4),
        (4, "one", "en", "a", 3),
        (4, "one", "en", "a", 3),
        (5, prose(1, 60), "en", "a", 300),
        (5, prose(1, 60), "en", "a", 300),
        (None, prose(2, 60), "en", "a", 300),
        (6, prose(3, 60_000, 9_000), "de", "b", 360_000),
        (7, "été " * 40, "fr", "b", 160),
    ]
