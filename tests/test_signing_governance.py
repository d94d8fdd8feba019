"""Signature findings and review plans by hand and against plain readers."""

from __future__ import annotations

import hashlib
import random
import re

from attestor.operators import governance, signing


def test_signal_gaps(spark):
    notes = [(1, "use SHA256 of it"), (1, "HashKey"), (2, "AES"), (3, "plain"), (4, None), (5, "全部加密 by AES"), (6, "sha256"), (7, "")]
    got = signing.signal_gaps(spark.createDataFrame(notes, "run int, text string"), spark.createDataFrame([(2,), (2,), (9,)], "run int"))
    assert sorted(map(tuple, got.collect())) == [(1, "HashKey"), (5, "加密")]


def test_runnable(spark):
    rows = [("AES-256-CBC", None, 1), ("aes", "cbc", 1), ("AES-CBC", "GCM", 1), ("AES", None, 1), ("AESX/CBC", None, 1), ("RSA-CBC", None, 1), ("AES-CBC", "", 0), (None, "CBC", 1), ("AES CBC", "", None)]
    df = spark.createDataFrame(rows, "a string, m string, n int")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(signing.is_runnable(F.col("a"), F.col("m"), F.col("n"))).collect()] == [True, True, False, False, False, False, False, False, False]


def plain_findings(schemes, examples):
    out = []
    for run in {s[0] for s in schemes}:
        mine = sorted((s for s in schemes if s[0] == run and s[3] in (None, "request", "signature")), key=lambda s: s[1])
        for i, (_, _, name, _, algorithm, mode, steps, field) in enumerate(mine):
            a, m = (algorithm or "").upper(), (mode or "").upper()
            if not (steps and re.search(r"(^|[^A-Z0-9])AES([^A-Z0-9]|$)", a) and (m == "CBC" if m else "CBC" in a)):
                continue
            label = name or str(i)
            if not field:
                out.append((run, label, f"integration.crypto.{label}", "REQUIRED_INFO_MISSING"))
                continue
            for r, path, content in examples:
                if r == run and re.search(r"request\.(ts|py)\Z", path) and re.search(rf"['\"]{re.escape(field)}['\"]\s*:", content or "") and not re.search(rf"\[['\"]{re.escape(field)}['\"]\]\s*=\s*sign\w*\(", content or ""):
                    out.append((run, label, path, "OUTPUT_MISMATCH"))
    return sorted(out)


def test_signatures_equal_a_reader(spark):
    r = random.Random(3)
    pick = r.choice
    schemes = [(run, i, pick([None, "", "s1", "s2"]), pick([None, "request", "signature", "response"]), pick(["AES-CBC", "AES", None, "DES"]), pick([None, "CBC", ""]), pick([0, 1, 2]), pick([None, "", "sig", "a.b", "x y"])) for run in range(30) for i in range(5)]
    bits = ['"sig": 1', "'sig' : f()", "# sig", '["sig"] = sign(', "['a.b']=sign_x (p)", "['a.b'] = sign_x(p)", '"a.b":', '"axb":', "'x y'\n:", '"x y"', "é", '"k":"sig":', "'p'\" : \"sig\":"]
    examples = [(run, f"ep{i}/{pick(['request.ts', 'request.py', 'request.sh', 'xrequest.py', 'request.py.md'])}", pick([None, *["; ".join(r.sample(bits, r.randrange(1, 7))) for _ in range(9)]])) for run in range(31) for i in range(4)]
    got = signing.signature_findings(spark.createDataFrame(schemes, "run int, ord int, name string, purpose string, algorithm string, mode string, steps int, field string"), spark.createDataFrame(examples, "run int, path string, content string"))
    want = plain_findings(schemes, examples)
    assert sorted(map(tuple, got.collect())) == want and len({w[3] for w in want}) == 2


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def test_snapshots_and_reviews(spark, tmp_path):
    a, b, c = b"alpha", b"beta", b"gamma"
    seen = [("x", "1", "changed", digest(a), a), ("x", "2", "changed", digest(a), b), ("x", "3", "unchanged", digest(c), c), ("y", "4", "changed", digest(b), b), ("z", "5", "changed", digest(c), None), ("w", "6", "changed", digest(c), c)]
    rows = governance.snapshot_sources(spark.createDataFrame(seen, "label string, id string, status string, sha256 string, raw binary")).collect()
    assert {r.id: r.error for r in rows} == {"1": None, "2": "digest mismatch", "4": None, "5": "not retained", "6": None}
    (tmp_path / "sources").mkdir()
    for r in rows:
        if r.error is None:
            (tmp_path / r.path).write_bytes(bytes(r.content))
    (tmp_path / f"sources/{digest(b)}.source").write_bytes(b"changed")
    (tmp_path / f"sources/{digest(c)}.source").unlink()
    (tmp_path / "sources/extra").write_bytes(b"extra")
    files = governance.landed_files(spark, str(tmp_path))
    ledger = spark.createDataFrame([(r.label, r.id, r.sha256, r.path) for r in rows if r.error is None], "label string, id string, sha256 string, path string")
    ledger = ledger.unionAll(ledger)
    states = {r.path: r.state for r in governance.verify_files(ledger, files).collect()}
    at = lambda raw: f"sources/{digest(raw)}.source"
    assert states == {at(a): "verified", at(b): "digest_mismatch", at(c): "missing", "sources/extra": "unlisted"}
    triggers = [("x", "source_changed", "r"), ("y", "source_changed", None), ("w", "freshness_inconclusive", None), ("v", "source_changed", None), ("u", "freshness_inconclusive", "r")]
    plan = {r.label: r for r in governance.review_plan(spark.createDataFrame(triggers, "label string, kind string, reason string"), ledger, files).collect()}
    assert {k: r.error for k, r in plan.items()} == {"x": None, "y": f"digest_mismatch: {at(b)}", "w": f"missing: {at(c)}", "v": "no verified snapshot", "u": None}
    assert [tuple(s) for s in plan["x"].sources] == [("1", digest(a), at(a))] and plan["x"].steps == governance.STEPS["source_changed"]
    assert plan["u"].sources == [] and plan["u"].steps == governance.STEPS["freshness_inconclusive"] and plan["y"].steps is None
    empty = spark.createDataFrame([], "path string, sha256 string")
    assert governance.verify_files(empty, empty).count() == 0
