"""Fixtures of the training-data tests."""

import pytest


@pytest.fixture()
def scratch(spark):
    from quern.llm.scratch import Scratch

    return Scratch(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def hard_docs(spark):
    """Nulls everywhere, empty and blank and very long texts, ties, repeated rows, clashing extra columns."""
    words = " ".join(f"w{i}" for i in range(80))
    rows = [
        (1, words, "en", "a", 10), (2, words, None, None, None), (2, words, None, None, None), (None, words, "en", "a", 1), (None, None, None, None, None),
        (3, None, "en", "a", 1), (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 4), (6, "one two", "en", "a", 7), (7, "One TWO", "en", "a", 7),
        (8, "é" * 5000, "fr", "b", 5000), (9, " ".join(f"long{i} ÄÖ" for i in range(30000)), "de", "b", 1), (-10, "a\x00b  c\u3000d\x85e 日本", "ja", "b", 9),
        (11, words.replace("w5 ", "x5 "), "en", "a", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for c in ("key", "cut_id", "gone_id", "cut_spans", "doc", "set", "h", "sequence_id", "offset", "score", "component", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
