"""Small tables with the awkward rows every operator must bear."""

import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
    (3, None, "en", "a"),
    (4, "", "fr", "b"),
    (5, " \n\t ", None, "b"),
    (6, LONG, "en", None),
    (7, "L'été à la plage était très agréable pour les élèves fatigués", "fr", "b"),
    (8, "12345 67890 !!! ???", "de", "c"),
    (None, "a row that has no identifier at all", "en", "c"),
    (9, "x" * 3000, "de", "c"),
    (10, "\u4e2d\u6587 \U0001f600 mixed \u00e9 text", None, "c"),
    (11, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture
def awkward(spark):
    """Nulls everywhere, empty, blank, very long and repeated texts, clashing extra columns."""
    rows = [(*r, "clash", 7, 0.5) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA + ", id string, n int, score double").repartition(3)


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark):
    def make(texts):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)

    return make
