from __future__ import annotations

import random

import pytest

SYLLABLES = "ka lo mi ta ve su po ni ra du fe go hi ju".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words, invented and repeatable."""

    def write(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))

    return write


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, source) with columns beside that carry names the operators use inside."""

    def build(rows, ids="long", parts=3):
        rows = [(*r, "src0")[:3] for r in rows]
        frame = spark.createDataFrame([(i, t, s, 0.5, "x", None, 7) for i, t, s in rows],
                                      f"doc_id {ids}, text string, source string, score double, label string, id string, n_chars int")
        return frame.repartition(parts) if rows else frame

    return build
