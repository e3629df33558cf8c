import random
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, doc_tokens long"
#: Columns whose names the operators use inside.
CLASH = ("xx", "s", 1, 7, 9)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = ["".join(random.Random(i).choices(string.ascii_lowercase, k=2 + i % 7)) for i in range(400)]


def corpus():
    """Copies, near copies, shared passages, odd and empty texts, nulls, repeated and null ids."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    base = prose(rng, 150)
    texts += [base] * 6
    for _ in range(8):
        w = base.split()
        w[rng.randrange(len(w))] = "Changed"
        texts.append(" ".join(w))
    passage = prose(rng, 60)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 15) for _ in range(5)]
    texts += ["", None, "   ", "one", "One two three", "A" * 700, "ab" * 400, "é" * 300, "Ünï  cødé\tτext\n\nwith  marks!  <|endoftext|> 123,456.", "知识图谱 " * 40, "\n\n lead and trail \n", base + " " + base]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, base), (None, None), (5, "another text under a known id")]
    return [(i, t, *CLASH) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
