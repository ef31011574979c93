import pytest

#: Texts that every operator has to take.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest at night"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest at night"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\f\r "),
    (6, "word"),
    (None, "a text whose owner has no number but which is long enough to be looked at by every rule of the house"),
    (None, None),
    (7, "é日本 \x85\xa0 <|endoftext|> don't 'll  x\n\n\ny 12345 \U0001f600 ՘"),
    (8, "same line here\nsame line here\nsame line here\nother line there"),
    (9, "lorem ipsum dolor " * 20000),
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest at night"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns, some named as results are."""
    rows = [(i, t, f"lang{k}", "src", k, "x", "y", -1.0, 0, "z") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, fp string, score double, n_tokens int, kept string"
    ).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def both(odd, documents):
    """Odd and ordinary documents in one table."""
    from pyspark.sql import functions as F

    moved = documents.select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    return odd.select("doc_id", "text").unionByName(moved)
