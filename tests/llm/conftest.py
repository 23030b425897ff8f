import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, score string, `row` string, component_id string, kept string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with more columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] is not None else None, "x", "y", "z", "r", "c", "k") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


LONG = "lorem ipsum dolor sit amet " * 40_000  # a million characters


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty, blank and very long texts, ties, repeated rows."""
    return make_docs([(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "a"), (5, "a"), (6, "a"), (None, "b"), (None, None), (7, "İ ß é́ 🙂   x"), (8, "word " * 50)])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
