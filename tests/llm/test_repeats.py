from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np

from attestor.llm.anchors import CHUNK, WINDOW, anchors
from attestor.llm.interleave import build_shard, merge, repeated_windows
from attestor.llm.repeats import remove_repeats
from tests.llm.conftest import prose


def brute(texts):
    data = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(d[p : p + WINDOW] for _, d in data for p in range(len(d) - WINDOW + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - WINDOW + 1):
            if count[d[p : p + WINDOW]] > 1:
                gone[p : p + WINDOW] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(d) else 0
        out.append((str(i), len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, texts, **args):
    df = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, sha string")
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, **args).collect())


def passages():
    shared = prose(50, 60)
    rows = [(i, prose(60 + i, 40) + " " + shared + " " + prose(90 + i, 10 + i)) for i in range(15)]
    rows += [(50, shared[:199]), (51, shared[:200]), (52, prose(1, 50) + "\n" + shared[50:260] + "é" * 30 + shared[:230]), (53, "x" * 199), (54, "y" * 260), (55, prose(3, 90)), (56, prose(3, 90).replace("a", "b", 1))]
    return rows


def test_matches_brute_force(spark, texts):
    rows = [(i, t if t is None else t[:3000]) for i, t in texts] + [(100 + i, t) for i, t in passages()]
    assert run(spark, rows) == brute(rows)


def test_groups_above_and_below_the_limit(spark, monkeypatch):
    import attestor.llm.repeats as module

    rows = passages()
    assert run(spark, rows, group=0) == run(spark, rows, group=2) == brute(rows)  # all, or the larger ones, window by window
    monkeypatch.setattr(module, "BATCH", 4)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_texts_have_the_same_anchors_in_chunks():
    data = (prose(4, CHUNK // 5)).encode()
    assert len(data) > CHUNK + 500
    pos, hashes, context = anchors(data)
    lo = CHUNK - 2000
    part, h, c = anchors(data[lo : lo + 4000])
    inner = (part > 200) & (part < 3600)
    have = dict(zip(pos.tolist(), zip(hashes.tolist(), context.tolist())))
    assert [have.get(p + lo) for p in part[inner].tolist()] == list(zip(h[inner].tolist(), c[inner].tolist()))
    assert np.diff(pos).max() <= WINDOW - 64 + 1


def made(r, n):
    return [r.integers(0, 2, r.integers(0, 60)).tolist() for _ in range(n)]


def test_merged_shards_are_in_order_and_know_what_they_share():
    r = np.random.default_rng(3)
    for depth in (1, 3, 8, 24):
        strings = made(r, 24)
        strings += [strings[3] + [2], [5] + strings[3], strings[5], [], [], [0, 1] * 30, [0, 1] * 25, [70_000, 1, 1]]
        for n_shards in (1, 2, 5):
            shard_of = r.integers(0, n_shards, len(strings))
            shards, where = [], []
            for s in np.unique(shard_of):
                mine = [i for i in range(len(strings)) if shard_of[i] == s]
                shards.append(build_shard(np.array(sum((strings[i] for i in mine), []), np.int64), np.array([len(strings[i]) for i in mine]), depth))
                places = [(i, p) for i in mine for p in range(len(strings[i]) + 1)]
                where += [places[k] for k in shards[-1].order]
            merged, same = merge(shards, depth)
            texts = [strings[i][p:] for i, p in (where[k] for k in merged)]
            ends = [(t + [10**9])[:depth] for t in texts]
            assert ends == sorted(ends) and sorted(merged.tolist()) == list(range(sum(len(s) + 1 for s in strings)))
            for a, b, shares in zip(texts, texts[1:], same[1:]):
                assert shares == (len(a) >= depth and len(b) >= depth and a[:depth] == b[:depth])


def test_a_shard_is_sorted_in_full():
    strings = made(np.random.default_rng(4), 30) + [[1] * 200, [1] * 300]
    shard = build_shard(np.array(sum(strings, [])), np.array([len(s) for s in strings]), 16)
    places = [(i, p) for i, s in enumerate(strings) for p in range(len(s) + 1)]
    keys = [[*strings[i][p:], 1000 + i] for i, p in (places[k] for k in shard.order)]
    assert keys == sorted(keys)


def test_repeated_windows_of_a_group():
    r = np.random.default_rng(5)
    for side, window in ((16, 24), (24, 32), (30, 40)):
        strings, at = [], []
        for i in range(300):
            left, right = (b"".join(r.choice([b"aaaa", b"abba"], 8))[: r.integers(side // 2, side + 1)] for _ in range(2))
            strings.append(left[::-1] + b"ANCHOR%02d" % r.integers(0, 6) + right)
            at.append(len(left))
        got = repeated_windows(strings, np.array(at), r.integers(0, 3, 300), window, side)
        seen = Counter(x for s, a in zip(strings, at) for x in {(d, s[a - d : a - d + window]) for d in range(min(a, side) + 1) if a - d + window <= len(s)})
        for k, (s, a) in enumerate(zip(strings, at)):
            for d in range(side + 1):
                assert got[k, d] == (d <= a and a - d + window <= len(s) and seen[d, s[a - d : a - d + window]] > 1)
        assert got.any() and not got.all()
    assert repeated_windows([], np.zeros(0, int), np.zeros(0, int), 200, 136).shape == (0, 137)
