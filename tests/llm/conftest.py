"""Documents with the awkward cases, for every operator."""

from __future__ import annotations

import random

import pytest

VOCABULARY = [f"w{i}" for i in range(400)] + ["the", "of", "été", "straße"]


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]) for k in range(0, n, 12))


def edited(rng: random.Random, text: str, times: int) -> str:
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """(doc_id, text, lang, source): null and empty texts, copies, families of near copies, a long one, repeats."""
    rng = random.Random(7)
    out = [(1, None, "en", "src0"), (2, "", None, None), (3, " \n\t ", "en", "src1"), (4, "one", "fr", "src0"), (5, "ONE", "fr", "src0"), (6, "a b c", None, "src2")]
    shared = prose(rng, 60)
    for family in range(4):
        base = prose(rng, rng.choice((40, 150, 400)))
        for k in range(30):
            near = edited(rng, base, rng.randrange(0, 4))
            out.append((100 + family * 50 + k, near, "en", "src0"))
    for k in range(20):
        out.append((400 + k, f"{shared}\n{prose(rng, 80)}", "de", "src3"))
    out += [(500 + k, prose(rng, 5 + 3 * k), "fr", f"src{k % 4}") for k in range(30)]
    out.append((600, prose(rng, 30_000), "es", "src1"))
    return out


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
