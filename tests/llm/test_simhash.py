from __future__ import annotations

import random
import re

import xxhash

from attestor.llm.components import connected_components
from attestor.llm.simhash import link_fingerprints, simhash_components
from attestor.session import Workspace


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(docs, texts):
    rows = simhash_components(docs).collect()
    assert len(rows) == len(texts)
    want = sorted((str(i), f"{plain_fingerprint(t):016x}") for i, t in texts)
    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == want
    fps = {plain_fingerprint(t) for _, t in texts}
    root = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t in texts:
        if i is not None:
            k = root[plain_fingerprint(t)]
            least[k] = min(least.get(k, i), i)
    assert all(r.component_id == least[root[int(r.fingerprint, 16)]] for r in rows)


def test_empty(no_docs):
    assert simhash_components(no_docs).collect() == []


def near_fingerprints(n=700):
    r = random.Random(3)
    center, out = r.getrandbits(64), set()
    while len(out) < n:
        x = center
        for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 6])):
            x ^= 1 << b
        out.add(x)
    out |= {r.getrandbits(64) for _ in range(300)}
    return [x - (1 << 64) if x >> 63 else x for x in out]


def check_links(spark, bucket):
    fps = near_fingerprints()
    work = Workspace(spark, "test")
    links = link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), work, bucket=bucket)
    roots = {r.node: r.root for r in connected_components(links, "fp", "root", work).collect()}
    want = plain_components(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {x: roots.get(x, x) for x in fps} == want


def test_dense_groups_lose_no_link(spark):
    check_links(spark, 2048)


def test_large_buckets_are_cut_further(spark):
    check_links(spark, 8)


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (7, None), (1, 2), (2, 1)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Workspace(spark, "test"))
    got = {r.node: r.root for r in out.collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, **{i: 1000 for i in range(1000, 1100)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", Workspace(spark, "test")).count() == 0
