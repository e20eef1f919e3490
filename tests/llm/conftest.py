import pytest

ODD_TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "a b c d"), (None, "a null id"), (None, None), (7, "word " * 3000),
    (8, "x" * 20000), (9, "été déjà vu — ünïcödé 😀 ok"), (9, "été déjà vu — ünïcödé 😀 ok"), (-3, "\x00 zero   line　wide"), (11, "<|endoftext|> and <|startoftext|>"),
]
# Columns that operators use for themselves must not clash with those of a table.
EXTRA = "n_tokens string, score string, n string, v string, c string, secrets string, hit_items string, host string, seq int"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, long, repeated and odd rows, with further columns of clashing names."""
    rows = [(i, t, "a", "b", "c", "d", "e", "f", "g", "h", 1) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest test tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_texts():
    return ODD_TEXTS
