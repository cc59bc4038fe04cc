import pytest


@pytest.fixture(scope="session")
def documents(spark, small):
    """(doc_id, text) pairs of the smallest table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def rows(spark):
    """Build a documents table, with columns that clash with the operators' own."""

    def make(pairs):
        return spark.createDataFrame([(d, t, "x", 0.5, 1) for d, t in pairs], "doc_id long, text string, kept string, score double, chunk int")

    return make
