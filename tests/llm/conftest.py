import pytest
from pyspark.sql import functions as F
from samples import prose


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty, short and very long texts, repeated rows, and columns whose names clash."""
    long = prose(20_000, 1)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", 3),
        (4, "word", "de", "b", 4),
        (5, long, "en", "a", len(long)),
        (6, prose(120, 2), "fr", "b", 1),
        (6, prose(120, 2), "fr", "b", 1),
        (7, prose(120, 2), "fr", "c", 1),
        (None, prose(60, 3), None, None, None),
        (8, "Ünïcödé 😀 text with a few words\nand lines\nand lines", "de", "c", 9),
        (9, "1.2.3.4.5 " * 50 + "+1 (555) 123-4567 a@b.co", "en", "c", 9),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("x") for c in ("size", "shard", "fp", "key", "mark", "kept", "n_words", "target", "quality", "__size", "at", "first", "rate", "component_id", "role")}
    return d.withColumns(clash)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
