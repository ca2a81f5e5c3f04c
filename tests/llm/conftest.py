"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

import random

import pytest

WORDS = "the of and lemon river stone quiet letter window garden forty seven under branch winter".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(90)) if r.random() < 0.5 else "") for _ in range(n))


#: (doc_id, text, lang, source, n_chars)
MESSY = [
    (1, prose(1, 120), "en", "a", 1),
    (2, prose(1, 120), "en", "a", 1),  # the same text
    (2, prose(1, 120), "en", "a", 1),  # a repeated row
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 4),
    (None, "no id " + prose(2, 30), "en", "b", 3),
    (None, None, None, None, None),
    (6, prose(6, 60000), "de", "c", 9),  # long
    (7, "é ü " + prose(7, 80), "fr", "c", 9),
    (8, "one", "en", "a", 3),
    (9, "one", "en", None, 3),
]

#: Names that operators use for results or while they work.
CLASHING = ["score", "predicted", "size", "shard", "SLOT", "copy", "copies", "rate", "order_key", "h", "d", "_h",
            "heavy", "part", "_part", "label", "held_out", "doc", "words", "key", "variant", "class_id", "_keeper",
            "_part_h", "_part_d", "n", "mask", "digest", "first", "word", "prefix", "worker", "ids", "n_words", "repeated",
            "good", "toxic", "item", "at", "node", "root", "_chunk", "_n", "_cuts", "_big_h", "piece", "cell"]

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(MESSY, COLUMNS)
    return df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small_docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")
