import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, place int, copies long, held_out string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43, 1, 1, 1, "x"),
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43, 1, 1, 1, "x"),
        (2, None, "en", "b", None, None, None, None, None),
        (3, "", None, None, 0, 3, 3, 3, "y"),
        (4, "der schnelle braune fuchs " * 20000, "de", "b", 520000, 4, 4, 4, "z"),
        (5, "1234 5678 !!", "de", None, 12, 5, 5, 5, "z"),
        (None, "ohne Nummer und ohne Namen", "de", "b", 26, 6, 6, 6, "z"),
        (7, " café \U0001f600 naïve\t日本語\n", "fr", "c", 17, 7, 7, 7, "z"),
        (8, "the QUICK brown fox jumps over the lazy dog", "en", "a", 43, 8, 8, 8, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
