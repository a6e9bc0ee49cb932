import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, bin int, size int, part int, v long, c long, score string, bucket string, spans string, __id long, taken int, shard int, label string"
EXTRA = (1, 2, 3, 4, 5, 6, "x", "y", "z", 7, 8, 9, "w")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, names that the operators use inside."""
    words = random.Random(1)
    long = " ".join("".join(words.choice("abcdeé") for _ in range(words.randrange(1, 9))) for _ in range(40_000))
    rows = [(1, "hello world. hello moon", "en", "a"), (2, None, None, None), (3, "", "en", ""), (None, "some text", "de", "a"), (5, "dup dup", "en", "b"), (5, "dup dup", "en", "b"), (6, long, "fr", "a"), (7, "   \n\t ", None, "b"), (8, "hello world. hello moon", "en", None), (9, "x" * 5000, "en", "c"), (5, "other text", "en", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
