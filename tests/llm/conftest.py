import pytest


@pytest.fixture
def docs(spark):
    """Build a small documents table; missing columns are null and one extra column clashes with outputs."""

    def make(rows):
        out = [(d, t, lang, "s", None if t is None else len(t), -1) for d, t, lang in rows]
        return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, score int")

    return make
