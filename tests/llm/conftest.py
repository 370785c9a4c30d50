import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text, source), with columns of names that operators use too."""

    def build(rows):
        wide = [(i, t, "en", s, None if t is None else len(t), 1, "x", 2.0) for i, t, s in rows]
        return spark.createDataFrame(wide, DOCS + ", size int, score string, target double")

    return build


@pytest.fixture
def odd():
    """Nulls, empty, blank and very long texts, repeated rows, a null id and a null source."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    return [(1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, long, "a"), (5, "one two three four five six", None), (5, "one two three four five six", None), (None, "Some text. here", "a"), (7, "Ünï çødé 漢字 text!", "b")]
