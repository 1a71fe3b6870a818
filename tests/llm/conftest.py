import pytest

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def edge_rows():
    """Documents with nulls in every column, empty and very long texts, repeated rows, ties and columns whose names clash."""
    text = "The quick brown fox jumps over the lazy dog and runs far away from here today."
    return [
        (1, text, "en", "a", 1, "x", 0.5, 7),
        (1, text, "en", "a", 1, "x", 0.5, 7),
        (2, None, None, None, None, None, None, None),
        (None, "", "en", "a", 0, "x", 0.5, 7),
        (3, "", "en", "a", 0, "x", 0.5, 7),
        (None, None, None, None, None, None, None, None),
        (4, LONG, "la", "b", 5, "x", 0.5, 7),
        (5, "!!! ??? ...", "en", "b", 5, "x", 0.5, 7),
        (6, "word", "en", "b", 5, "x", 0.5, 7),
        (7, "a\u0000b 😀 ünïcödé ﷽ 1\n\n\ttab".encode("utf-16", "surrogatepass").decode("utf-16"), "xx", "b", 5, "x", 0.5, 7),
        (8, "x" * 50_000, "en", "b", 5, "x", 0.5, 7),
    ]


EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __uid string, score double, contamination int"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path
