import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    prose = " ".join(f"w{k * 7 % 101}x{k}" for k in range(120))
    rows = [(1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose, None, None), (None, prose + " more", "en", "b"), (None, None, None, None), (3, "", "fr", "a"), (4, long, "en", "b"), (5, "one", "en", "a"), (6, "token = abcdef123 \n\n x", "en", "c"), (6, "other text", "en", "c"), (7, " \t\n", "en", "a")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 9, "z", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, bucket int")


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return spark.createDataFrame([], odd_documents.schema)
