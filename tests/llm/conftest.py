import random

import pytest

CLASHES = ["size", "n_words", "score", "rank", "block", "key", "doc", "start", "end", "root", "words", "hits", "times", "leaf", "host", "n", "id"]

VOCABULARY = [f"w{i}" for i in range(400)]


def prose(seed: int, count: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCABULARY) for _ in range(count))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and columns of clashing names."""
    long = prose(1, 30_000)
    near = prose(2, 120)
    shared = prose(3, 40)
    rows = [
        (1, prose(4, 50), "en", "a"),
        (1, prose(4, 50), "en", "a"),
        (2, None, None, "a"),
        (3, "", "en", None),
        (4, " \t\n ", "en", None),
        (5, long, "en", "b"),
        (6, near, "en", "b"),
        (7, near + " tail", "en", "c"),
        (8, near.upper(), "de", "c"),
        (9, prose(5, 30) + " " + shared, "de", "a"),
        (10, shared + " " + prose(6, 30), None, "a"),
        (11, "ß é 日本 " * 40, "de", "é"),
        (None, prose(7, 20), "en", "a"),
        (None, prose(8, 20), "en", "a"),
        (12, "one two", "en", "a"),
        (13, "ONE two", "en", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def text_prose():
    return prose
