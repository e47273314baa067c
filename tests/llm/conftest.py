import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n long, h1 long, rank int, _key string, spans string"


def documents(spark, rows):
    """Documents with further columns named like things the operators make."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x", "y") for r in rows], EXTRA)


@pytest.fixture(scope="session")
def prose():
    return " ".join(f"word{i % 97} and the{i % 13}" for i in range(120)) + "."


@pytest.fixture(scope="session")
def messy(spark, prose):
    """Null ids, texts, languages and sources; empty, white, short and very long texts; rows that repeat."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, "a"), (4, "one", "en", None),
        (5, prose, "en", "a"), (6, prose, "de", "b"), (6, prose, "de", "b"), (7, prose.replace("word5", "other"), None, None),
        (None, prose, "en", "a"), (None, None, None, None), (8, long, "en", "b"), (8, "another text under eight", "en", "b"),
        (9, "a b  c \U0001f600 é́", "xx", "b"), (10, "\n\n\n", "en", "b"),
    ]
    return documents(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
