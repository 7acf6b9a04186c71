"""Fixtures of the corpus operators' tests: awkward small tables."""

import pytest

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank and very long texts, repeated ids and rows, clashing column names."""
    line = "This line is long enough to be counted, in every single document."
    rows = [
        (1, "alpha beta gamma delta\n" + line, "en", "a"),
        (2, "alpha beta gamma delta\n  " + line.upper() + "\t", "en", "a"),
        (3, None, "en", None),
        (4, "", None, "b"),
        (5, " \n\t ", "fr", "b"),
        (6, LONG + line, "en", "b"),
        (6, "same id, another text\n" + line, None, "c"),
        (7, "repeated row\n" + line, "fr", "c"),
        (7, "repeated row\n" + line, "fr", "c"),
        (None, "no id\n" + line, "de", "c"),
        (8, "naïve café ½ 日本 " + chr(0x1F600), "de", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    for name in ("h", "key", "fp", "size", "place", "body", "component_id", "hits", "n_chars", "u", "v", "node"):
        df = df.withColumn(name, F.lit(-1).cast("long"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
