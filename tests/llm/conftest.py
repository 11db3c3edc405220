import random

import pytest

DOC = "doc_id long, text string, n_words string, kept string, doc string, k string"  # names that operators use inside


def odd_documents(seed: int = 3) -> list[tuple]:
    """Nulls, empties, long texts, ties, repeated rows, near copies, shared lines and passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(12) for _ in range(6)]
    passage = line(120)
    base = line(150).split()
    docs = [None, "", " ", "\n\n", "one", "Two words", "a b c d e", "a b c d e", "\t\x0b weird \x0c spaces\r\n"]
    docs += [line(r.randint(1, 80)) for _ in range(20)]
    for _ in range(25):  # near copies of one text
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        docs.append(" ".join(w))
    docs += [" ".join(base)] * 5
    docs += ["\n".join([line(30), r.choice(shared).upper(), "  " + r.choice(shared) + " ", line(5)]) for _ in range(20)]
    docs += [line(40) + " " + passage + " " + line(r.randint(1, 60)) for _ in range(6)] + [passage, passage + " " + word()]
    docs += [line(3000), "x" * 3000, "ab" * 2000, (line(6) + "\n") * 40, "!!! ### $$$ " * 30]
    rows = [(i, t) for i, t in enumerate(docs)]
    return rows + rows[40:44]  # repeated rows


@pytest.fixture(scope="session")
def odd():
    return odd_documents()


@pytest.fixture(scope="session")
def odd_frame(spark, odd):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in odd], DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
