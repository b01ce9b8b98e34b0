from __future__ import annotations

import random

import pytest

from remitlake.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    common.ship(spark)


def make_rows() -> list[tuple]:
    """Null, empty, very long, repeated and near-equal rows, one hot source."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    rows = []
    for i in range(60):
        t = prose(rng.randint(12, 120))
        rows.append((i, t, "en", "hot" if i % 2 else f"s{i % 5}", len(t)))
    base = prose(100)
    for k in range(6):  # near copies
        words = base.split()
        words[10 * k + 5] = f"edit{k}"
        rows.append((100 + k, " ".join(words), "de", "s1", None))
    rows += [(200 + k, base, None, "hot", 5) for k in range(3)]  # copies
    rows += [(300, None, None, None, None), (301, "", "en", "s2", 0), (302, "  \n\t ", "en", None, 3), (303, "Two words", "en", "s3", 9), (303, "Two words", "en", "s3", 9), (None, "a row without an id has text as well, of more than ten words here", "en", "s1", 1)]
    long = "\n".join(prose(40) for _ in range(150))
    rows.append((400, long, "en", "s4", len(long)))
    rows.append((401, "Odd  spaces \n and\ttabs ▁marks▁ \U0001f389 日本語 <|endoftext|> <s>\x00", "xx", "s4", -1))
    return rows


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with extra columns whose names clash with working names and results."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.selectExpr("*", "1 as extra", "'x' as words", "7 as size").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
