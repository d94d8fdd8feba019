from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from attestor.llm.inner_product import top_k


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every:
            continue
        scores = ((max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q)  # a score is a long
        scored = sorted((-s, i) for s, i in scores)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=10, **args):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, norm string")
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % every == 0, k=k, **args).collect())


def vectors(n=300, d=24, seed=5):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) * (3 if i % 17 == 0 else 0.3) for _ in range(d)]) for i in range(n)]


def test_matches_brute_force_with_ties_and_odd_rows(spark):
    rows = vectors()
    rows += [(300 + i, rows[0][1]) for i in range(120)]  # a hot vector: ties
    rows += [(500, None), (501, [None] * 24), (502, [math.nan] * 24), (503, [math.inf] * 24), (None, [9.0] * 24), (504, [0.5] * 10), (505, []), (510, rows[3][1])]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_query_blocks_agree(spark):
    rows = vectors(200)
    assert run(spark, rows, every=2, query_block=16) == brute(rows, 5, 2)


def test_few_rows_large_values_and_none(spark):
    rows = [(0, [1e9, -1e9]), (1, [1e9, 1e9]), (2, [3e8, 0.1])]
    assert run(spark, rows) == brute(rows, 5, 10)
    exact = [(0, [1e6, -1e6]), (1, [1e6, 1e6 + 1]), (2, [-1e6, 1e6]), (3, [1e6, 1e6 + 2])]  # beyond 2**53, within a long
    assert run(spark, exact) == brute(exact, 5, 10) and abs(run(spark, exact)[0][3]) < 2**62
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_components_whose_squares_overflow(spark):
    rows = [(i, v) for i, v in vectors(60, 4)] + [(100, [1e200, 1.0, 0.0, 2.0]), (101, [1e200, -1e200, 1e160, 0.0]), (102, [1e-3, 2.0, 1e155, 1e300]), (110, [-1e300, 3.0, 1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_queries_that_repeat_an_id_have_lists_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((i, [i / 10, 1 - i / 10]) for i in range(1, 9))]
    got = run(spark, rows)
    lists = {}
    for q, rank, vec, score in got:
        assert q == 0
        lists.setdefault(rank, []).append((vec, score))
    assert sorted(lists) == [1, 2, 3, 4, 5] and all(len(v) == 2 for v in lists.values())
    assert {v for v, _ in lists[1]} == {1, 8}
