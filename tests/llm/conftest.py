import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, node long, d1 string, __t string"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with extra columns whose names operators use inside."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(i, t, lang, src, len(t or ""), 7, 8, "x", "y") for i, t, lang, src in full], SCHEMA)

    return make


#: Null, empty, blank, one sign, ties, repeats, line ends, signs beyond the first plane, and a long text.
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "Hello world, it's fine!\nLine two of it."), (6, "Hello world, it's fine!\nLine two of it."), (7, "😀 naïve café " * 40), (8, "word " * 4000 + "end"), (9, "x" * 3000)]
