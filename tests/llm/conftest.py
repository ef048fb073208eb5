import pytest

SF = "/root/testdata/sf0.001"

#: Edge cases every operator must survive: null and empty texts, blanks only,
#: a very long text, equal rows, a null id, unusual characters.
EDGE = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, "  the quick brown fox\tjumps over the lazy dog again and again \n"),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, "word " * 30000),
    (8, "x" * 40000),
    (9, "naïve café 　 日本語 \U0001f600 \x1c \x85 end"),
    (None, "a text without an id"),
    (None, None),
    (10, "one two three"),
    (11, "One TWO three"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with the edge cases and extra columns with clashing names."""
    rows = [(i, t, "kept", k, "v") for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n int, ids string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, kept string, n int, ids string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
