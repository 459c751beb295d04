import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (doc_id, text, source) rows."""

    def run(rows, extra=""):
        out = []
        for i, r in enumerate(rows):
            doc_id, text, source = r if isinstance(r, tuple) else (i, r, "s")
            out.append((doc_id, text, "en", source, len(text or "")))
        return spark.createDataFrame(out, SCHEMA)

    return run


LONG = "word " * 40_000
#: Null, empty, white space, long and repeated texts; repeated and null ids.
ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, LONG, "a"), (5, "one two three four five", "b"), (5, "one two three four five", "b"), (None, "one two three four five", None), (None, None, "b"), (8, "é日本\x00 x", "c")]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)
