import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use for themselves.
CLASHES = ["id", "fp", "score", "lang_pred", "k1", "k2", "spans", "kept", "n_words", "base", "_key", "_weak", "_row", "ids", "h", "piece", "length", "_text", "predicted", "node", "root"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows and ids, columns whose names clash."""
    from pyspark.sql import functions as F

    long = "one two three four five six seven eight nine ten " * 400
    rows = [(1, "Hello there, my friend. password=abcdefghijklmnop", "en", "s", 5), (1, "Hello there, my friend. password=abcdefghijklmnop", "en", "s", 5), (2, "", None, None, None), (3, None, "en", "s", 0), (4, " \n\t ", "de", "s", 3)]
    rows += [(None, "Guten Tag", "de", None, 9), (None, None, None, None, None), (5, long, "en", "s", len(long)), (6, long, None, "s", None), (2**62 + 1, "été 日本語 🙂", "fr", "s", 9), (5, "another text with the same id", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
