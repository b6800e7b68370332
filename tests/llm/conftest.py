import random

import pytest


@pytest.fixture
def rng():
    return random.Random(7)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture
def varied(rng):
    """Documents with nulls, empties, repeats, near copies in chains, long texts and clashing extra columns."""
    docs = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "One TWO"), (5, "one two three four five")]
    base = prose(rng, 120).split()
    for i in range(10, 40):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        docs.append((i, " ".join(w)))
    docs += [(i, prose(rng, rng.randrange(3, 200))) for i in range(40, 90)]
    docs += [(90, docs[50][1]), (91, docs[50][1].upper()), (92, prose(rng, 30_000)), (93, "äöü " * 400)]
    docs.append((94, docs[-2][1] + " tail"))
    return docs
