"""A small table with every odd case: nulls in each column, empty, blank and long texts, repeated rows, ties, a clashing extra column."""
import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, mark string"


def prose(seed: int, n: int, alphabet: str = "abcdefgh") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    long = prose(99, 30_000)
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, long), (8, long), (9, "ÄÖ 12 3.5 km " + prose(3, 40)),
            (None, base), (None, None), (10, "a\n" * 200), (11, prose(4, 60) + "\n" + prose(5, 60)), (12, prose(4, 60) + "\nother " + prose(6, 50)), (13, "!!! ??? 4.0.2.0")]
    return [(i, t, None if (i or 0) % 5 == 0 else "en", None if (i or 0) % 7 == 3 else f"s{(i or 0) % 3}", None if t is None else len(t), 7, "x") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
