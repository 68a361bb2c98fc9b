import random

import pytest

WORDS = "the of and to in that was his with for on are as at be this from they or an were which you one we all her she there would".split()


def prose(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "ing", "ed", "s"]) + rnd.choice(["", "", "", ",", ".\n"]) for _ in range(n))


EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, shard int, cls long, _key string, _d int, _row string, license string, n_links int"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, long, tied and repeated rows, with extra columns that clash."""
    base = prose(120, 1)
    texts = [
        (1, base), (2, base), (2, base), (3, base.replace("the", "thy", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "word"), (None, prose(80, 2)), (8, prose(40000, 3)), (9, "a b c d"),
        (10, "é ü ñ " * 30), (11, "12 34 !! ##"), (12, prose(90, 4)), (None, None), (13, "x\x00y\x1cz\x85w \U0001f600 end"), (14, prose(60, 5) + " " + prose(90, 4)),
    ]
    return [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b", "c"][k % 4], None, 5, False, 3, 9, "k", 1, "r", "L", 2) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
