import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Documents from (doc_id, text) or whole rows, with the columns of the table."""

    def make(*rows):
        whole = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(whole, DOCS)

    return make


@pytest.fixture(scope="session")
def given(spark):
    """(doc_id, text) of the smallest given table, and the table."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
