import pytest

SCHEMA = "doc_id long, text string, lang string, kept string, n_tokens double"

#: Nulls, no words, ties and repeated rows, a long text, clashing extra columns.
EDGES = [
    (1, None, "en", "x", 1.0),
    (2, "", None, None, None),
    (3, " \n\t ", "de", "y", 2.0),
    (4, "one two", None, None, None),
    (5, "one two", "fr", "z", 0.0),
    (5, "one two", "fr", "z", 0.0),
    (None, "a row without an id, of a few words", "en", None, None),
    (7, "Ünïcode  naïve text 日本語 👩‍👧 \x1c end ", "en", None, None),
    (8, "long " * 30_000 + "x" * 70_000, "en", None, None),
    (9, "word\n\nword\n word's 12.5 <|endoftext|>", "en", None, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
