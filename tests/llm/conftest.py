import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, task int, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, other scripts, and extra columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs through the old forest near a quiet river bank every day "
    rows = [
        (1, base * 3, "en", "a", 1), (2, base * 3, "en", "a", 1), (2, base * 3, "en", "a", 1), (3, "", "en", "b", 0), (4, None, None, None, None), (5, " \t\n ", "en", "b", 3),
        (6, "one two", "en", "a", 7), (7, "ONE two", "en", None, 7), (8, "one two three", "en", "a", 9), (9, "Élan été ß 中文 😂 😂😂  x y", "fr", "é", 9), (10, "a" * 120_000, "en", "a", 1),
        (11, "word " * 30_000, "en", "a", 1), (12, base * 3 + "tail words differ here", "en", "z", 1), (None, "no id at all " * 9, "en", "a", 1), (13, "x\0y \x1c z", "en", "c", 1), (14, base[::-1] * 2, "en", "c", 1),
    ]
    return spark.createDataFrame([(*r, "mine", 5, "k") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
