import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    def make(texts, extra=None):
        rows = [(i, t, "en", f"s{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
