import random

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string, row string, key string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdeinorstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names operators use inside."""

    def of(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "S", "W", "R", "K") for i, t, s in rows]
        return spark.createDataFrame(full, FIELDS)

    return of


@pytest.fixture(scope="session")
def edge(words):
    """Nulls in every place, empty and long texts, ties, repeated rows, copies."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + " the of and to."
    rows = [(i, text(rng.randint(1, 120)), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "  \n\t ", "c"), (103, text(30_000), "a"), (104, "x" * 200_000, "b")]
    rows += [(105, "\n".join(["same line here"] * 80), "a"), (106, "Ünïcödé ﷽ 𝒳 é   x\x85y z", "a")]
    rows += [(None, text(40), "a"), (None, None, None), (110, "tie words here", "a"), (110, "tie words here", "a"), (111, "tie words here", "b")]
    return rows
