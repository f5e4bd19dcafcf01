import pytest
from pyspark.sql import functions as F

TEXTS = [
    (1, "A first sentence stands here with words. And a second one follows it at once.\nThen a line.", "en", "a"),
    (1, "A first sentence stands here with words. And a second one follows it at once.\nThen a line.", "en", "a"),  # a repeated row
    (1, "the same id with another text", "en", "b"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n\x0b\x0c\r ", "de", "b"),
    (None, "no id at all", "en", "a"),
    (None, None, None, None),
    (5, "word " * 30_000, "en", "c"),
    (6, "x" * 50_000, "en", "c"),
    (7, "éß 漢字 \U0001f600 <|endoftext|> it's 10%", "fr", "ü"),
    (8, "MIT License", "en", ""),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns that operators use names like inside.
CLASHES = ("row_key", "fp", "k", "bucket", "root", "members", "size", "place", "rounds", "edge", "component_id", "s", "c", "ids", "count", "n")


@pytest.fixture(scope="session")
def dirty(spark):
    """Documents with every kind of trouble at once, and columns with clashing names."""
    df = spark.createDataFrame(TEXTS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    return df.cache()


@pytest.fixture(scope="session")
def nothing(dirty):
    return dirty.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"
