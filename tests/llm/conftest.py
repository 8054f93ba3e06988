import pytest

ODD = [
    # doc_id, text, lang, source, n_chars
    (1, "Plain words stand here, and more of them follow after that.", "en", "b", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "   \n\t ", "en", "a", 5),
    (5, "Plain words stand here, and more of them follow after that.", "en", "b", 1),
    (5, "Plain words stand here, and more of them follow after that.", "en", "b", 1),
    (6, "123 456 --- !!!", "en", "c", 9),
    (None, "A text whose identifier is missing, though it has words.", "en", "c", 9),
    (7, "Ünïcödé wörds ünd ßtraßen, 漢字 und mehr 😀 emoji", "de", "d", 9),
    (8, "long words repeat " * 20_000, "en", "b", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside
CLASHING = ("_id", "_text", "doc", "part", "n", "key", "size", "hits", "_fp", "label", "score", "_k", "curve", "start", "kept", "keep_id")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose
    names clash with those inside the operators."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def corpus(documents):
    return sorted((r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect())
