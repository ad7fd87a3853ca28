import random

import pytest

WORDS = "the of and to a in tion ther erly ing hand than with onea inter shth blean edon reer tiou".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, key string, _id string, part int"


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, repeated ids, and columns with names that operators use."""
    rng = random.Random(3)
    long = prose(rng, 5000)
    texts = [(1, prose(rng, 80)), (2, None), (3, ""), (4, "  \n "), (5, long), (5, "another text of this id"), (6, "42 !! --"), (None, prose(rng, 60)), (7, "x"), (8, "ÄÖÜ \x00 漢字 кириллица"), (None, None)]
    texts += [texts[0], texts[0], (9, texts[0][1])]
    rows = [(i, t, "en" if k % 2 else None, None, None, 0.5, "n", None, "x", 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
