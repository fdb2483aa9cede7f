import random

import pytest

#: Columns beside those that are read, with names that operators use inside.
EXTRA = "row string, term string, label string, _w string, kept string, text_hash string, n_words string"


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): null, empty, blank, short, very long, repeated rows, a null id, letters beyond ASCII."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Delta,", "été", "x1."]) for _ in range(60_000)) + " tail"
    return [
        (1, None), (2, ""), (3, " \n\t \x0b"), (4, "one"), (5, "one two"), (6, long), (7, "A b c d e f, g."), (7, "A b c d e f, g."),
        (None, "A b c d e f, g."), (8, "a B c d e f, g."), (9, "naïve café 日本語 \U0001f600 ½ x"), (10, "same same same same same same"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    rows = [(i, t, "x", "x", "x", "x", "x", "x", "x") for i, t in odd_texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
