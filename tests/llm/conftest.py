import random

import pytest

VOCABULARY = [f"w{i}" for i in range(3000)]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return lambda n: [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="session")
def awkward(spark, words):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and extra columns
    whose names clash with internal ones, or with those of documents but for case."""
    long = " ".join(words(30_000))
    mail = "write to a.b@c.org or 10.0.0.1 now"
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (3, long, "en", "a", 0), (4, "one two", "en", None, 7), (None, "three four five six seven", "en", "b", 1), (6, mail, "en", "b", 2), (6, mail, "en", "b", 2), (8, long, "en", "c", 3), (9, mail, "de", "a", 4)]
    return spark.createDataFrame([(*r, "x", i, None, 1.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, k string, TEXT_ long, `Text.2` string, _score double")


@pytest.fixture(scope="session")
def clash(awkward):
    """The same with a column that differs from text only in case."""
    return awkward.toDF("doc_id", "text", "lang", "source", "n_chars", "k", "TEXT", "h", "_score")


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return spark.createDataFrame([], awkward.schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 0), (6, None, 1), (None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark, words):
    return spark.createDataFrame([(1, " ".join(words(20))), (2, None), (3, ""), (4, "one two"), (None, "three four five six")], "item_id long, text string")
