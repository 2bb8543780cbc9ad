import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, place string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    words = [f"w{i}" for i in range(400)]
    base, near = " ".join(words[:120]), " ".join([*words[:119], "other"])
    passage = " ".join(words[200:270])
    rows = [
        (1, base, "en", "s", 1, 1, "x"), (2, base.replace(" ", "\t"), "en", None, 1, 1, "x"), (3, near.upper(), None, "s", None, None, None), (4, None, "en", "s", 1, 1, "x"),
        (5, "", "de", "s", 0, 1, "x"), (6, " \n ", "de", "s", 3, 1, "x"), (7, "one two", "fr", "s", 7, 1, "x"), (7, "one two", "fr", "s", 7, 1, "x"), (8, "ONE two", "fr", "s", 7, 1, "x"),
        (9, "begin " + passage + " end", "en", "s", 1, 1, "x"), (10, "start here " + passage, "en", "s", 1, 1, "x"), (None, base, "en", "s", 1, 1, "x"), (11, "lorem " * 30_000, "en", "s", 1, 1, "x"), (12, "naïve café 日本語 <|endoftext|> 😀", "fr", "s", 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
