from __future__ import annotations

import random
import re

import numpy as np
import pytest

from attestor.llm.wide_simhash import WORDS, _mixed, nearest_forest, shingle_hashes, similar_components, wide_fingerprint
from tests.llm.conftest import prose
from tests.llm.test_simhash import plain_components


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 9000])
def test_fingerprint_is_the_majority_of_bits(n):
    hashes = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    bits, holes = wide_fingerprint(hashes)
    sums = np.array([[int((m >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for m in _mixed(hashes)]).reshape(-1)
    assert len(bits) == WORDS * 64 and (bits == (2 * sums > n)).all()
    assert holes.shape == (64, 4) and len(set(holes[0].tolist())) == 4


def test_forest_joins_what_is_near():
    r = random.Random(2)
    center = [r.getrandbits(64) for _ in range(WORDS)]
    fps = [[x ^ (1 << r.randrange(64) if k < i % 5 else 0) for k, x in enumerate(center)] for i in range(40)]
    fps += [[r.getrandbits(64) for _ in range(WORDS)] for _ in range(5)]
    edges = nearest_forest(np.array(fps, np.uint64), 6)
    got = {n: n for n in range(45)}
    for a, b in edges:
        low, high = sorted((got[a], got[b]))
        got = {n: low if v == high else v for n, v in got.items()}
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True))
    assert got == plain_components(range(45), lambda a, b: apart(a, b) <= 6)


def near_copies():
    r = random.Random(5)
    out = []
    for base in range(30):
        words = prose(1000 + base, r.choice([60, 200, 900])).split()
        out.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for _ in range(r.choice([1, len(words) // 100 + 1, len(words) // 60 + 1, len(words) // 12])):
                copy[r.randrange(len(copy))] = "changed" + str(r.randrange(999))
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("bucket", [2048, 2])
def test_near_copies_against_brute_force(spark, bucket):
    texts = near_copies()
    sets = [plain_shingles(t) for t in texts]
    want = plain_components(range(len(texts)), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    rows = similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bucket=bucket).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == len(texts) and all(want[i] == want[c] for i, c in got.items())
    linked = [i for i in got if want[i] != i]
    assert sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked) > 30


def test_odd_rows(spark, docs, texts, no_docs):
    rows = similar_components(docs).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[20] == by[21] == by[22] == by[23] == by[None] == {20}
    assert by[24] == by[25] == by[26] == {24} and by[27] == {27} and by[28] == {28} and by[34] == {34} and by[29] == {29}
    assert similar_components(no_docs).collect() == []
    assert len(shingle_hashes("a b c d e f", 5)) == 2


def bridged_families(n, copies=40):
    """Families of A, B and copies C: A and B at exactly 0.8, every C at 0.782 to both and at 0.88 to the others (450 shingles, of which a changed word takes five)."""
    out = []
    for seed in range(n):
        r = random.Random(7000 + seed)
        a = [f"w{r.getrandbits(40)}" for _ in range(454)]
        at = [10 + 25 * k for k in r.sample(range(17), 16)]
        b = list(a)
        for k in at[:10]:
            b[k] = f"b{r.getrandbits(40)}"
        family = [a, b]
        for _ in range(copies):
            c = list(a)
            for k in at[:5]:
                c[k] = b[k]
            for k in at[10:]:
                c[k] = f"c{r.getrandbits(40)}"
            family.append(c)
        out.append([" ".join(x) for x in family])
    return out


def test_a_link_is_found_where_nearer_edges_fail(spark):
    families = bridged_families(10)
    rows = [(100 * n + k, text) for n, family in enumerate(families) for k, text in enumerate(family)]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, family in enumerate(families):
        sets = [plain_shingles(t) for t in family]
        assert jaccard(sets[0], sets[1]) == 0.8 > max(jaccard(x, c) for x in sets[:2] for c in sets[2:])
        assert all(got[100 * n + k] >= 100 * n + 2 for k in range(2, len(family)))
    assert sum(got[100 * n + 1] == 100 * n for n in range(len(families))) == len(families)
