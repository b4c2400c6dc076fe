import pytest

ODD = [
    (1, "plain words here, and 12 more"), (2, ""), (3, None), (4, "a"), (5, " \n\t "), (6, "ñandú Ünïcode 日本語 <|endoftext|> x<|endoftext|>"),
    (7, "word " * 30000), (8, "x" * 5000), (9, "plain words here, and 12 more"), (9, "plain words here, and 12 more"), (None, "no id"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, "en", 1, 2, 3, 4) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, grp long, n_tokens long, score long, media long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
