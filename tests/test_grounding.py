"""Grounded contracts against a plain reading of each claim."""

from __future__ import annotations

import json
import random

from attestor.operators import grounding as g


def esc(s):
    return str(s).replace("~", "~0").replace("/", "~1")


def test_random_claims(spark):
    r = random.Random(3)
    names, claims, told = ["a", "b/c", "d~", None, 7], [], []
    for c in range(3):
        for i in range(40):
            kind = r.choice(["operation", "schema", "webhook", "no such kind"])
            value = {"parameters": [{"name": r.choice(names), "location": r.choice(["query", "x/y", None])} for _ in range(3)] + ["odd"], "responses": [{"status_code": r.choice(["200", 404, None])}], "fields": [{"name": r.choice(names)} for _ in range(3)]}
            value = r.choice([value, value, value, [1, "x", None], "text", None])
            claims.append((c, f"c{i}", kind, r.choice(["supported", "waived", "missing", "conflicting", "unverified"]), None if value is None else json.dumps(value), r.choice([None, [], ["f1", "f9"]])))
            for n in range(r.randint(0, 5)):
                path = r.choice([None, "", "/path", "/parameters/query/a", "/parameters/query/a/", "/parameters/x~1y/b~1c/name", "/responses/200/schema_ref", "/responses/404/a/b", "/fields/d~0/type", "/fields/7/x", "/fields"])
                told.append((c, f"c{i}", n, f"r{n}", f"f{r.randint(1, 3)}", path, "explicit_support"))
    told.append((0, "nobody", 0, "r", "f", "/path", "explicit_support"))
    a = spark.createDataFrame(claims, "contract int, identity string, claim_kind string, status string, value string, evidence_refs array<string>")
    b = spark.createDataFrame(r.sample(told, len(told)), "contract int, claim_identity string, ord int, id string, fragment_id string, claim_path string, relationship string")
    evident = g.claim_evidence(a, b).cache()

    def proofs(c, i):
        return [t for t in told if t[:2] == (c, i)]

    want = {}
    for c, i, *_, refs in claims:
        have = [t[4] for t in proofs(c, i)]
        want[c, i] = have + [f for f in refs or [] if f not in have]
    assert {(x.contract, x.identity): [e.fragment_id for e in x.evidence] for x in evident.collect()} == want

    good = {(c, i): (kind, json.loads(v)) for c, i, kind, status, v, _ in claims if status in ("supported", "waived") and kind in g.COLLECTIONS and v and v.startswith("{")}
    assert {(x.contract, x.identity): x.collection for x in g.grounded_items(evident).collect()} == {k: g.COLLECTIONS[kind] for k, (kind, _) in good.items()}
    assert {(x.contract, x.identity, x.reason) for x in g.gaps(evident).collect()} == {(c, i, "source fact missing") for c, i, _, s, *_ in claims if s == "missing"}
    split = lambda v: [None] if v is None else json.loads(v) if v.startswith("[") else [json.loads(v)]
    assert {(x.contract, x.identity): [json.loads(v) for v in x["values"]] for x in g.conflicts(evident).collect()} == {(c, i): split(v) for c, i, _, s, v, _ in claims if s == "conflicting"}

    children = {}
    for (c, i), (kind, value) in good.items():
        for name in {"operation": ["parameters", "responses"], "schema": ["fields"]}.get(kind, []):
            for pos, child in enumerate(value[name]):
                parts = None
                if isinstance(child, dict):
                    parts = {"parameters": [child.get("location"), child.get("name")], "responses": [child.get("status_code")], "fields": [child.get("name")]}[name]
                prefix = None if parts is None or None in parts else f"/{name}/" + "".join(esc(p) + "/" for p in parts)
                children[c, i, name, pos] = [t[4] for t in proofs(c, i) if prefix and t[5] and t[5].startswith(prefix)]
    found = g.child_evidence(g.grounded_items(evident), b)
    assert {(x.contract, x.identity, x.child, x.pos): [e.fragment_id for e in x.evidence] for x in found.collect()} == children
    assert any(children.values())
