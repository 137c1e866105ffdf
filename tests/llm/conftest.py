import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, rows, extra=""):
    """(doc_id, text) pairs as documents; ``extra`` adds columns of clashing names."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return df if not extra else df.selectExpr("*", *[f"'x' as {c}" for c in extra.split()])


def words(rnd, n, size=400):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


@pytest.fixture()
def rnd():
    return random.Random(5)


@pytest.fixture()
def odd():
    """Null, empty, blank, very long, repeated and tied rows."""
    long = "long text here " * 20_000
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two three"), (5, "one two three"), (None, "one two three"), (None, None), (6, "é ß 漢 😀"), (7, "x")]
