import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, class string, `key` string, rank int, id string"
LONG = "wort " * 60_000 + "x" * 30_000


def documents(spark, texts, first=0):
    """Documents with clashing further columns."""
    rows = [(first + n, t, "en", "s", 1, 0.5, 3, "c", "k", 1, "i") for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, and repeated rows."""
    texts = ["", None, " \n\t ", "One two three.", "One two three.", LONG, "é 漢字 😀 don't 123\n\nx", "a\x00b", "<|endoftext|> <s>"]
    rows = [(n, t, "en", "s", 1, 0.5, 3, "c", "k", 1, "i") for n, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "One two three.", None, None, None, None, None, None, None, None, None), (None, None, None, *[None] * 8)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
