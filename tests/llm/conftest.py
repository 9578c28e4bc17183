import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "the quick brown fox jumps over a lazy dog while seven small birds watch from the old wall nearby"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    long_text = " ".join(f"word{i % 9000}" for i in range(60_000))
    rows = [
        (1, PLAIN, "en", "a", 1), (1, PLAIN, "en", "a", 1), (2, PLAIN, None, None, None), (3, None, None, "a", None),
        (4, "", "en", "b", 0), (5, "   \n\t ", "fr", "b", 0), (None, None, None, None, None), (None, PLAIN + " end", "en", "a", 3),
        (6, long_text, "en", "a", 9), (7, PLAIN.upper(), "en", "c", 1), (8, "x", "de", "c", 1), (9, "un deux trois quatre cinq", "fr", "b", 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as fp", "2 as t", "3 as row", "4 as k", "5 as verdict", "6 as contamination", "7 as shard", "8 as m", "9 as id", "10 as h", "11 as key")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
