import random

import pytest


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, a very long text, repeated rows, ties."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "straße", "日本", "x1", "don't", "END."]
    long = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(30_000))
    prose = [" ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(60)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\r\n \n"), (4, long), (5, "word"), (6, "a b c\nA B C \n\nother line"), (7, None), (8, "\n\n"), (9, "<|endoftext|> tail  of   blanks ")]
    rows += [(10 + k, p) for k, p in enumerate(prose)] + [(20, prose[0]), (21, prose[0] + " more"), (10, prose[0])]
    rows += [(30 + k, f"shared line\nown text number {k} of these {k * k} rows") for k in range(12)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd rows with columns whose names clash with what the operators use."""
    rows = [(a, b, "en", "s", 7, 0.5, "k", 1, 2) for a, b in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, h1 int, n int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
