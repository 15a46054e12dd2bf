import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and repeated rows, ties, a long text, and a column of another name."""
    prose = "the cat and the dog ran over the hill while the sun was low and the wind was cold"
    rows = [
        (1, prose, "en", "b", 1, "x"), (2, prose, "en", "a", 1, "x"), (3, None, "en", "a", None, None), (4, "", None, "a", 0, None), (5, " \n\t ", "de", None, 4, None), (6, "one two", "de", None, 7, None),
        (7, prose.replace("hill", "bank"), None, "b", 1, "x"), (8, " ".join(f"w{i % 977} x{i}" for i in range(20000)), "en", "b", 1, "x"), (8, prose, "en", "b", 1, "x"), (9, "12 34 !!", "fr", "c", 8, "x"),
        (9, "12 34 !!", "fr", "c", 8, "x"), (None, prose, "en", "a", 1, "x"), (11, "é à 😀 " + prose, "fr", "c", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
