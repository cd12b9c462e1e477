import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text and clashing extra columns."""
    long = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta", "a"), (2, "alpha BETA gamma delta", "a"), (3, "", "a"), (4, None, "b"),
        (5, " \n\t ", None), (6, "Ärger straße", None), (7, "ärger straße", ""), (7, "ärger straße", ""),
        (None, "no id here", "b"), (None, None, None), (8, long, "b"), (9, long.upper(), "c"), (10, "x" * 20_000, "c"),
        (11, "one. two!! three\nfour, five; six", "c"),
    ]
    out = [(*r, 1, "x", 2.0, "y", 3, 4, True, 5, 6) for r in rows]
    return spark.createDataFrame(
        out, "doc_id bigint, text string, source string, n int, recipe string, size double, ids string, key int, "
             "part int, kept boolean, target int, row int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
