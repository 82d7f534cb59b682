import pytest


@pytest.fixture
def docs(spark):
    """A small table of documents from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows, lang=None):
        full = [(i, t, (lang or {}).get(i), "s", len(t or ""), 0.5, 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens int").repartition(2)

    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame([(i, q, t) for i, q, t in rows], "doc_id long, quality int, toxic int")

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "a b c d"), (None, "no id at all here and there"), (6, "x" * 5000), (7, "日本語 の テキスト です ね"), (8, "same text twice in this table"), (8, "same text twice in this table")]


@pytest.fixture
def odd():
    return ODD
