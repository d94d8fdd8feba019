from __future__ import annotations

import zlib

import numpy as np

from attestor.llm import quality


def test_held_out_accuracy_and_null_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out]
    good, bad = [r for r in test if r.quality == 1], [r for r in test if r.quality == 0]
    assert len(good) > 30 and len(bad) > 5
    assert np.mean([r.predicted == 1 for r in good]) >= 0.97 and np.mean([r.predicted == 0 for r in bad]) >= 0.9


def test_labels_of_the_held_out_fold_change_nothing(docs, spark):
    ids = [i for i in range(32)]
    rows = [(i, i % 2) for i in ids]
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in rows]
    a, b = (sorted((str(r.doc_id), r.score) for r in quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (rows, flipped))
    assert a == b and len(a) == docs.count()


def test_odd_inputs(docs, no_docs, spark):
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(no_docs, none).count() == 0


def test_the_risk_is_never_negative_for_separable_data():
    r = np.random.default_rng(0)
    n = quality.N_FEATURES
    good, bad = r.normal(1, 0.3, (200, n)), r.normal(-1, 0.3, (60, n))
    model = quality.fit(good, np.concatenate([r.normal(1, 0.3, (240, n)), bad]), 0.8)
    assert model.score(good).min() > 0.5 and model.score(bad).max() < 0.5


def naive_features(text):
    """The features of a text, byte by byte and word by word."""
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * (quality.N_FEATURES - 1) + [1.0]
    punct = [b for b in range(33, 127) if not chr(b).isalnum()]
    out = [sum(x == b for x in data) / n for b in punct]
    count = lambda test: sum(map(test, data))
    upper, lower = count(lambda x: 65 <= x <= 90), count(lambda x: 97 <= x <= 122)
    words = data.split()
    size = [len(w) for w in words]
    share = lambda test: sum(map(test, words)) / len(words) if words else 0.0
    mean = sum(size) / len(size) if size else 0.0
    deviation = (sum((s - mean) ** 2 for s in size) / len(size)) ** 0.5 if size else 0.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    out += [
        np.log1p(n) / 10, upper / n, lower / n, count(lambda x: 48 <= x <= 57) / n, count(lambda x: x > 127) / n, count(lambda x: x == 10) / n, count(lambda x: x == 32) / n, upper / max(1, upper + lower),
        mean / 10, deviation / 10, share(lambda w: len(w) > 20), share(lambda w: len(w) == 1), share(lambda w: w[-1] in punct and w[-1] not in b".,;:?'\")"), share(lambda w: w[-1] in punct and w[max(0, len(w) - 2)] in punct), share(lambda w: len(w) == 1 and w[0] in punct),
        share(lambda w: 65 <= w[0] <= 90), share(lambda w: w[-1] in b".?!"), 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / max(1, len(words)), sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)),
    ]
    return out + [0.0] * (quality.N_FEATURES - len(out))


def test_features_equal_a_count_byte_by_byte(texts, monkeypatch):
    some = [(t or "")[:3000] for _, t in texts] + ["A!! b?? c ;; ; 12\n\n12\n12 the the The", " \t ", "É é漢 x"]
    for piece in (quality.PIECE, 7):
        monkeypatch.setattr(quality, "PIECE", piece)
        for text in some:
            assert np.allclose(quality.features(text), naive_features(text), atol=1e-12)


def test_the_fit_reaches_the_least_non_negative_risk():
    r = np.random.default_rng(7)
    for prior, gap in ((0.5, 1.0), (0.8, 0.6), (0.3, 1.5)):
        positives = r.normal(gap, 1, (400, 1))
        unlabelled = np.concatenate([r.normal(gap, 1, (int(600 * prior), 1)), r.normal(-gap, 1, (600 - int(600 * prior), 1))])
        model = quality.fit(positives, unlabelled, prior)
        p, u = model.expand(positives), model.expand(unlabelled)

        def risk(w):
            sp, su = p @ w, u @ w
            return prior * np.logaddexp(0, -sp).mean() + max(0.0, np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean())

        best, step, at = np.inf, 2.0, np.zeros(3)
        while step > 0.02:  # a search of the grid around the best point, ever finer
            grid = [at + step * np.array(d) for d in np.ndindex(3, 3, 3) for d in [np.array(d) - 1]]
            values = [risk(w) for w in grid]
            k = int(np.argmin(values))
            step, at, best = (step / 2, at, best) if values[k] >= best - 1e-9 else (step, grid[k], values[k])
        assert risk(model.weights) <= best + 0.01


def test_rows_that_repeat_an_id_stay_within_the_bound(spark, monkeypatch):
    from attestor.llm import quality

    collected = []
    plain = quality._collect
    monkeypatch.setattr(quality, "_collect", lambda df, text_col: collected.append(plain(df, text_col)) or collected[-1])
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, "same")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    quality.train(docs, labels, fit_rows=10)
    assert [len(x) for x in collected] == [10, 10]
    collected.clear()
    quality.train(docs.where("doc_id = 2"), spark.createDataFrame([(2, 1)], "doc_id long, quality int"), fit_rows=10)
    assert [len(x) for x in collected] == [1, 1]  # identical rows count once
