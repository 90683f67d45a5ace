import pytest

#: Columns whose names meet those that operators use inside.
CLASH = "doc_id bigint, text string, source string, lang string, n_chars bigint, _text string, _id bigint, key bigint, label int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text, source) with further columns whose names clash."""

    def make(rows):
        wide = [(i, t, s, "en", None if t is None else len(t), "x", 7, 8, 9) for i, t, s in rows]
        return spark.createDataFrame(wide, CLASH)

    return make
