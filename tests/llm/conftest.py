import pytest

#: Names that operators use inside, or that a careless one would.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, label string, key string, fp string, n string, h string, word string, _source string"


def edge_rows():
    """Null and empty texts, one word, repeated rows, a null id, a long text."""
    texts = [(1, None), (2, ""), (3, "one"), (4, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "no id here at all"), (7, " \t\n "), (8, "Ünïcode wörds — ok? " * 3), (9, "long words go on and on " * 3000)]
    return [(i, t, "en", "s", None if t is None else len(t), "x", "y", "k", "f", "n", "h", "w", "q") for i, t in texts]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), CLASH).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASH)
