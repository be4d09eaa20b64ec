import random

import pytest

WORDS = [a + b for a in "ka lo mi ru te zo ba ne pi su".split() for b in "nd st rk lp mm x ff rt sh q".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens long, shard int, h string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, and extra columns whose names could clash."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = prose(99, 80)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "de", "a"), (3, " ".join(near), "de", "a"), (4, prose(4, 100), None, None), (5, "", "en", "a"), (6, None, "en", "b"),
        (7, " \n\t ", "en", "b"), (8, "one two", "en", "a"), (9, prose(9, 60_000), "en", "c"), (None, base, "en", "a"), (None, None, None, None), (10, prose(10, 30) + " " + shared + " " + prose(11, 30), "en", "a"),
        (11, prose(12, 45) + "\n" + shared, "en", "c"), (12, "one two", "en", "c"), (13, prose(13, 100), "en", "b"), (13, prose(14, 100), "en", "b"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, 7, 3, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
