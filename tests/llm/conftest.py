import random

import pytest

WORDS = ["the", "of", "and", "thion", "Été", "straße", "mañana", "ed,", "re.", "x" * 40, "###", "a|b", "12", "日本"]


def passage(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(30)) * draw.randrange(2) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Odd cases: null, empty, blank, repeated lines, unusual blanks, a very long text, equal rows, a null id."""
    long = passage(1, 30_000)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, passage(2, 200)), (5, passage(2, 200)), (6, long)]
    rows += [(7, "\n".join([passage(3, 20)] * 4 + ["", "", passage(4, 20)])), (8, "a  b  c \n\n d\te\x1c f"), (9, "<|endoftext|> x <|startoftext|>")]
    rows += [(10, " lead and trail "), (4, passage(2, 200)), (None, passage(5, 90)), (11, "Σίσυφος ΟΔΟΣ don't we'll x's"), (12, passage(6, 3000))]
    return rows + [(i, passage(i, 5 + i * 7 % 300)) for i in range(20, 120)]


@pytest.fixture()
def documents(spark, texts):
    """The rows above, with columns whose names clash with the results'."""
    rows = [(i, t, "en", "src", 7, -1, "x") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string").repartition(3)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
