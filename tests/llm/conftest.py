import pytest

EXTRA = "tag string, codes string, bucket string, rank string, size string, key string, component string, a string, _row string, _times string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows, with columns named as the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", None, *["x"] * 10) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_documents(documents):
    """Nulls, empty and blank texts, ties, repeated rows, a text without spaces, a very long text."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(20_000))
    return documents([
        (1, "the quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""), (4, " \t\n "),
        (5, "the quick brown fox jumps over the lazy dog near the river bank today"), (6, "One Two three"), (7, "one two THREE", None),
        (8, "x" * 5000), (9, long), (10, long), (11, "é" * 200, "books"), (12, "é" * 200, "books"), (13, "é" * 200 + " tail", None),
        (14, "one"), (None, "a row without an id, long enough to hold a window of fifty bytes"), (15, "same row"), (15, "same row"),
        (None, None, None),
    ])
