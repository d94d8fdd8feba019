from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("th", "er", "an", "in", "on", "re", "st", "ou") for b in ("ble", "tion", "ing", "ed", "a", "en", "ha", "and")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, null, empty and very long texts, odd white space, and a row without id."""
    base = prose(1, 120)
    out = [(i, prose(100 + i, 20 + 7 * i)) for i in range(12)]
    out += [(20, base), (21, base), (22, base.replace("thble", "thbla", 1)), (23, base + " extra tail"), (24, None), (25, ""), (26, "  \t\n"), (27, "one"), (28, "One  two"), (29, prose(7, 30_000))]
    out += [(30, "Ünï côdé ▁ mark and 漢字 emoji 🙂 text"), (31, prose(7, 40) + " " + base[:400]), (32, "x" * 450), (33, "ab" * 300), (None, base), (34, prose(8, 50)), (34, prose(8, 50))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None, "clash", 1.5) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
