import pytest

from tidemark.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i} the of and" for i in range(20_000))
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t ", "en", "s", 4),
            (None, "a  b c d", "en", "s", 8), (None, None, None, None, None), (5, long, "en", "s", len(long)), (6, long, "en", "s", len(long)), (7, "x", "fr", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("keep_id", "digest", "body", "salt", "row", "_row", "tag", "pos", "fp", "component_id", "root", "learn", "bucket"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
