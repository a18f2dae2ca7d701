import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, spans string, base string, label int, score double"


def words(rnd, n, size=400):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters, columns that clash with inner names."""
    rnd = random.Random(3)
    long_text = " ".join(words(rnd, 30_000))
    passage = " ".join(words(rnd, 60))
    texts = [
        (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one  TWO"), (6, long_text), (7, long_text), (8, passage), (9, f"x y z {passage} q r s"),
        (10, "Ünïcödé 日本語 　 é ﬁ \x01\x00 <s> </s> <|endoftext|> ▁▁ a▁b"), (11, "a" * 3000), (12, "mail me@x.example.com or +1 (269) 555-3296 4111111111111111, 10.0.0.1"),
        (13, "a b c " * 40), (13, "a b c " * 40), (14, "line\nline\nother line\n\nline"), (15, "# * $ % & | < >"),
    ]
    rows = [(i, t, None if i is None else ["en", "fr", None][i % 3], None, None, "x", "y", "z", "b", None, None) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
