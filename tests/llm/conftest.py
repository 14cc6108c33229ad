import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, head string, n long, size long"


@pytest.fixture
def documents(spark):
    """(doc_id, text[, source]) rows as documents with extra columns whose names clash with inner ones."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "h", 7, 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
