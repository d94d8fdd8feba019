"""Ranked search against every document scored one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    words = [PATTERN.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, n_terms = sum(1 for w in words if w), sum(map(len, words))
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), w, c in zip(docs, words, counts, strict=True):
            if not w:
                continue
            m = 100 - 50 + (50 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(PATTERN.findall((text or "").translate(LOWER))) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "thble ANing, restion"), (1, "thble ANing, restion"), (2, "漢字 é emoji one"), (None, "x" * 450), (3, ""), (4, None), (5, "ab" * 300 + " nothere"), (6, "thble " * 50 + "enha onand")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_odd_rows(spark, docs, texts, no_docs, items):
    from attestor.llm.impact_index import rank_documents

    for k in (1, 3, 50):
        assert Counter(map(tuple, rank_documents(docs, items, k).collect())) == plain(texts, ITEMS, k)
    assert rank_documents(no_docs, items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0


def test_small_blocks_steps_and_passes(spark, items, monkeypatch):
    from attestor.llm import impact_index

    for name, value in (("BLOCK_DOCS", 70), ("BLOCK_POSTINGS", 300), ("STEP", 40)):
        monkeypatch.setattr(impact_index, name, value)
    r = random.Random(4)
    words = ["thble", "aning", "restion", "enha", "onand", "é", "one", "漢字", "of", "x1"]
    rows = [(r.randrange(400) if r.random() < 0.98 else None, " ".join(r.choices(words, [9, 1, 1, 3, 1, 1, 2, 1, 20, 5], k=r.randint(0, 60)))) for _ in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, impact_index.rank_documents(docs, items, 20, pass_bytes=200).collect())) == plain(rows, ITEMS, 20)


def test_bitmaps_add_and_choose_like_integers():
    import numpy as np
    import zstandard

    from attestor.llm.impact_index import Block, slices

    r = np.random.default_rng(1)
    for n in (1, 63, 64, 200):
        held = [(np.sort(r.choice(n, r.integers(1, n + 1), replace=False)), None) for _ in range(9)]
        held = [(p, r.integers(1, 1 << r.integers(1, 40), len(p))) for p, _ in held]
        made = [slices(*x) for x in held]
        body = zstandard.compress(b"".join([w.tobytes() for w, _ in made] + [s.tobytes() for _, s in made]))
        block = Block(list(range(n)), list(range(9)), [len(s) for _, s in made], [len(w) for w, _ in made], body)
        want = np.zeros(n, np.int64)
        for p, v in held:
            want[p] += v
        for k in (1, 5, 1000):
            docs, scores = block.top([*range(9), 77], k)
            best = sorted((-s, i) for i, s in enumerate(want.tolist()) if s)[:k]
            assert sorted((-s, d) for d, s in zip(docs, scores, strict=True)) == best
        assert block.top([77], 5) == ([], [])


def test_query_is_its_sql(spark, sf_dir):
    from attestor.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = queries()["op11_ranked_search"](spark, sf_dir)
    columns = ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(con.sql(oracle_sql()["op11_ranked_search"]).select(*columns).fetchall())
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
