import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names clash with those of results."""
    long = " ".join(f"w{i % 977} thing{i % 13}." for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a", 10),
        (1, "one two three four five six seven eight nine ten", "en", "a", 10),
        (2, "One two three four five six seven eight nine ten", None, None, None),
        (3, "", "en", "a", 0),
        (4, None, "en", "a", None),
        (None, "text without an id that has some words in it", "en", "b", 1),
        (None, None, None, None, None),
        (5, long, "en", "b", len(long)),
        (6, "  \n\t ", "", "", 5),
        (7, "übergrößen 日本語 😀 <|endoftext|> a@b.example.com", "de", "c", 5),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", "doc_id as score", "text as node", "doc_id as key", "text as spans", "doc_id as kept", "1 as length", "1 as replica", "1 as _raw_")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
