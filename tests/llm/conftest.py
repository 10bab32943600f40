import pytest

from tests.llm.helpers import SCHEMA


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, source]) as a table like `documents`."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def awkward(documents):
    """Nulls everywhere, an empty and a very long text, repeated rows."""
    rows = [(1, "the same text again " * 30), (1, "the same text again " * 30), (None, "no id"), (None, None), (2, None), (3, ""), (4, "x" * 200_000), (5, "a b c " * 50_000), (6, "中文 \U0001f600 café")]
    return documents([(i, t, None) for i, t in rows])
