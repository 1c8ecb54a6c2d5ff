import random

import pytest


@pytest.fixture
def documents(spark):
    """A DataFrame of documents from (doc_id, text[, lang, source]) rows, with extra columns of clashing names."""

    def make(rows, parts=2):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts)
        return df.selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars", "'x' AS size", "1 AS n", "2 AS a", "3 AS component", "4 AS rep", "5 AS id", "6 AS class")

    return make


@pytest.fixture
def prose():
    """prose(seed, n): n made-up words, the same for one seed."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))

    return make
