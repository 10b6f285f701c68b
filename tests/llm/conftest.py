import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, label int, bucket long, id string"


def doc(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), -1, -1, -1, -1, "x")


LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows; the columns clash with names that operators use."""
    return [
        doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "..."), doc(5, LONG), doc(6, LONG + " end"),
        doc(7, "Alpha beta gamma delta"), doc(7, "Alpha beta gamma delta"), doc(8, "alpha BETA gamma delta", None),
        doc(None, "a text without a key", None), doc(None, "a text without a key", "b"), doc(9, "é ü ñ 😀 漢字", "é"),
        doc(10, "Alpha beta gamma delta", "b"), doc(11, "one"), doc(12, "one two", "b"), doc(-3, "zero\0byte \x01 text"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
