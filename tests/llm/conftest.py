import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, n int, shard int, prefix string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 997} x{i % 31}." for i in range(15_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, "   \n \t", None, "a"), (4, "one", "en", "a"), (5, "one", "en", "b"),
        (6, "The same words come here again and again\nA line of its own stands here now", "en", "a"),
        (7, "The same words come here again and again\nA line of its own stood here now", "en", "b"),
        (7, "The same words come here again and again\nA line of its own stood here now", "en", "b"),
        (8, long, "de", "c"), (9, long + " tail", "de", None), (10, "!!! 123 ???", "fr", "a"), (None, "no id but words to read here", None, "a"),
        (11, "Ünïcödé 日本語 🙂 don't 'S it's\r\nx\u00a0y", "fr", "b"),
    ]
    return spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None, "clash", 7, 3, "p") for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
