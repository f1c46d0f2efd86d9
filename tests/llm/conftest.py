import pytest

pytest.importorskip("simigraph.llm")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text); with columns whose names also occur inside operators."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)

    return make


@pytest.fixture
def odd(documents):
    """Nulls, empty texts, repeated rows, ties, a very long text."""
    long = " ".join(f"word{k % 977} of{k % 31}" for k in range(30_000))
    return documents([(1, None), (2, ""), (3, "one"), (3, "one"), (None, "one"), (None, None), (4, long), (5, long), (6, " \n\t "), (7, "é ü 漢字 🙂\nzwei")])
