import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copy int, bands string, slot string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, equal texts, columns with names the operators use."""
    long_text = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"), (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"), (3, "", "en", "b"), (4, None, "fr", None), (5, " \t\n ", None, "b"), (6, long_text, "de", "a"),
        (7, long_text + " end", "de", "a"), (None, "no id here", "en", "a"), (8, "éàü ß 中文字 🙂 x", None, None), (9, "one", "en", "c"), (10, "1234 !!", "en", "c"), (11, "a" * 5000, "es", "c"),
    ]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), 3, None, "x", "y") for i, t, la, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
