import pytest

ODD = [
    (None, "No id here, but a text of some words.", "en", "web", 1),
    (1, None, None, None, 2),
    (2, "", "en", "web", 3),
    (3, " \n\t ", "en", None, 4),
    (4, "12 34 ... !!", "en", "web", 5),
    (5, "One text that is here twice, in equal rows.", "en", "books", 6),
    (5, "One text that is here twice, in equal rows.", "en", "books", 6),
    (6, "Same id, other text, nothing in common with it at all.", "de", "books", 7),
    (6, "Und noch ein anderer Text, der dieselbe Nummer trägt.", "de", "books", 7),
    (7, "word " * 30_000, "en", "long", 8),
    (8, "x" * 60_000, None, "long", 9),
    (9, "naïve café 日本語 👩‍👩‍👧 \x00   end", "fr", "ué", 10),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every oddity, and further columns named as inner ones may be."""
    return spark.createDataFrame(
        [(*row, 0, "c", -1) for row in ODD],
        "doc_id long, text string, lang string, source string, n_chars long, _text int, _plan string, _id int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
