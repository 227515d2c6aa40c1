import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies and repeated rows, and columns with clashing names."""
    base = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))
    near = base.replace("word5x5 ", "changed ", 1)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "b", 5), (3, near, None, "a", None), (4, None, "en", None, None), (5, "", None, "a", 0),
        (6, " \n\t ", "en", "a", 3), (7, "one two", "de", "b", 7), (8, "one two", "de", "b", 7), (None, base, "en", "a", 1), (None, None, None, None, None),
        (9, "x " * 30_000, "en", "a", 60_000), (10, "ééé 漢字 😀 " * 50, "fr", "c", 1), (11, "a" * 50_000, "en", "c", 1), (1, base, "en", "a", 5),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(f"clash {c}") for c in ("id", "bucket", "word", "n", "source_", "batch", "key", "own", "first", "score", "kept", "part")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
