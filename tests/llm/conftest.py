import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, lang="en"):
        rows = [(i, t, lang, "src0", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
