import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of odd row, and columns whose names clash with those the operators make."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog today", "en", "a", 49, 1.0, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 2.0, "y"),
        (4, "   \n\t ", "fr", None, 6, 3.0, "y"),
        (5, "the quick brown fox jumps over the lazy dog today", None, "b", 49, 4.0, "z"),
        (5, "the quick brown fox jumps over the lazy dog today", None, "b", 49, 4.0, "z"),
        (None, "no id at all here", "en", "a", 17, None, "z"),
        (7, "ünï çødé 😀 text with signs; and more of it", "de", "c", 43, 0.5, "z"),
        (8, "word " * 60_000, "en", "a", 300_000, 0.5, "z"),
        (9, "secret: abcdefghijkl0123 and AKIA" + "Q" * 16, "en", "a", 53, 0.5, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, blob string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
