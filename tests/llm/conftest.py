import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, source]) tuples."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Null and empty texts, a long one, ties, repeated rows, null ids and sources, and columns that operators use inside."""
    rows = [
        (1, "the cat sat on the mat and looked at the other cat", "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"), (5, "one", "b"),
        (6, "same text here", "b"), (7, "same text here", None), (7, "same text here", None), (None, "nobody's words are here", "a"),
        (8, "long word " * 30_000, "b"), (9, "x" * 50_000, "c"), (10, "é ü   ☃ wide", "c"),
    ]
    return docs_of(rows).withColumns({c: F.lit("clash") for c in ("bits", "label", "weight", "part", "size", "target", "_rank", "score", "start")})
