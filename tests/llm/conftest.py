import random

import pytest

WORDS = [a + b + c for a in ("ba", "co", "di", "fu", "ge") for b in ("la", "mi", "no", "ru") for c in ("s", "t", "n", "")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


#: Rows with nulls, empty and very long texts, ties, repeats, and columns whose names clash with inner ones.
def odd_rows():
    long = prose(1, 30_000)
    return [(1, "Same Text", "a", "en"), (2, "same text", "a", "en"), (2, "same text", "a", "en"), (3, None, None, None), (4, "", "b", "de"), (None, "SAME text", "b", None), (5, long, "a", "en"), (6, long + " x", "a", "en"), (None, None, None, None), (7, "É été x", "c", "fr")]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 5, "z", 1, "k", 0) for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, digest string, row int, item string, size int").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
