"""Comparison of documents against a recursion over both in plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest

from attestor.operators import schema_graph
from attestor.operators.schema_graph import RULES, compare_documents
from attestor.session import Workspace
from tests.test_derivations import random_document


def is_object(s):
    return isinstance(s, dict) and (s.get("type") == "object" or "type" not in s and isinstance(s.get("properties"), dict))


def signature(s):
    if not isinstance(s, dict):
        return s
    out = {k: s[k] for k in ("type", "$ref", "enum", "oneOf", "anyOf", "allOf", "format") if k in s}
    return json.dumps(out | ({"type": "object"} if is_object(s) else {}), sort_keys=True)


def named(doc, ref):
    """(name, schema) of a local reference."""
    if isinstance(ref, str) and ref.startswith("#/components/schemas/"):
        key = ref[21:].replace("~1", "/").replace("~0", "~")
        schemas = doc.get("components", {}).get("schemas", {})
        if isinstance(schemas.get(key), dict):
            return ref, schemas[key]
    return None


def plain(base, head, follow):
    out = []
    level = []

    def operations(doc):
        return {f"{m.upper()} {p}": op for p, item in doc.get("paths", {}).items() for m, op in item.items() if m in ("get", "post", "put")}

    def media(a, b, area, at, kind):
        x, y = ({k: v["schema"] for k, v in h.get("content", {}).items()} for h in (a, b))
        out.extend(("additive", area, f"{at}.{k}", f"{kind} added") for k in y.keys() - x.keys())
        out.extend(("breaking", area, f"{at}.{k}", f"{kind} removed") for k in x.keys() - y.keys())
        level.extend((area, f"{at}.{k}", (at, k, "L"), x[k], (at, k, "R"), y[k]) for k in x.keys() & y.keys())

    left, right = operations(base), operations(head)
    for key in left.keys() & right.keys():
        a, b = left[key], right[key]
        x, y = a.get("requestBody"), b.get("requestBody")
        if x is not None and y is not None and bool(x.get("required")) != bool(y.get("required")):
            out.append(("breaking", "openapi.requestBody", f"{key} requestBody.required", "request body became required") if y.get("required") else ("changed", "openapi.requestBody", f"{key} requestBody.required", "request body no longer required"))
        media(x or {}, y or {}, "openapi.requestBody", f"{key} requestBody", "request media type")
        x, y = a.get("responses", {}), b.get("responses", {})
        out += [("additive", "openapi.responses", f"{key} responses.{k}", "response added") for k in y.keys() - x.keys()]
        out += [("breaking", "openapi.responses", f"{key} responses.{k}", "response removed") for k in x.keys() - y.keys()]
        for k in x.keys() & y.keys():
            media(x[k], y[k], "openapi.responses", f"{key} responses.{k}", "response media type")
    x, y = (d.get("components", {}).get("schemas", {}) for d in (base, head))
    where = "components.schemas"
    out += [("additive", "openapi.schemas", f"{where}.{k}", "schema added") for k in y.keys() - x.keys()]
    out += [("changed", "openapi.schemas", f"{where}.{k}", "schema removed") for k in x.keys() - y.keys()]
    for k in x.keys() & y.keys():
        if isinstance(x[k], dict) and isinstance(y[k], dict):
            name = "#/components/schemas/" + k.replace("~", "~0").replace("/", "~1")
            level.append(("openapi.schemas", f"{where}.{k}", name, x[k], name, y[k]))
        elif x[k] != y[k]:
            out.append(("breaking", "openapi.schemas", f"{where}.{k}", "schema changed"))

    seen = set()
    while level:
        following = []
        for area, at, a_id, a, b_id, b in sorted(level, key=lambda p: p[1]):
            if (area, a_id, b_id) in seen:
                continue
            seen.add((area, a_id, b_id))
            adds, removes = RULES[area]
            if signature(a) != signature(b):
                out.append(("breaking", area, at, "schema changed"))
                if is_object(a) != is_object(b):
                    continue
            if not isinstance(a, dict) or not isinstance(b, dict):
                a, b = (s if isinstance(s, dict) else {} for s in (a, b))
            p, q = (s.get("properties") if isinstance(s.get("properties"), dict) else {} for s in (a, b))
            r, s = (set(map(str, z.get("required"))) if isinstance(z.get("required"), list) else set() for z in (a, b))
            out += [("breaking", area, f"{at}.{n}", "required property added") if n in s and adds else ("additive", area, f"{at}.{n}", "optional property added") for n in q.keys() - p.keys()]
            out += [("breaking" if removes else "changed", area, f"{at}.{n}", "property removed") for n in p.keys() - q.keys()]
            out += [("breaking", area, f"{at}.{n}", "property became required") for n in s - r if n in p and n in q]
            out += [("changed", area, f"{at}.{n}", "property no longer required") for n in r - s]
            following += [(area, f"{at}.{n}", (a_id, n), p[n], (b_id, n), q[n]) for n in p.keys() & q.keys()]
            if isinstance(a.get("items"), dict) and isinstance(b.get("items"), dict):
                following.append((area, f"{at}[]", (a_id, 0), a["items"], (b_id, 0), b["items"]))
            x, y = named(base, a.get("$ref")), named(head, b.get("$ref"))
            if follow and x and y:
                following.append((area, at, *x, *y))
        level = following
    return Counter(out)


@pytest.mark.parametrize("follow", [False, True])
def test_random_documents(spark, follow):
    r = random.Random(11)
    pairs = [(random_document(r), random_document(r)) for _ in range(60)]
    for a, b in pairs[:30]:  # a version of itself, changed at a few places
        b.clear()
        b.update(json.loads(json.dumps(a)))
        for op in (o for item in b["paths"].values() for o in item.values()):
            op["requestBody"]["required"] = True
        if isinstance(b["components"]["schemas"]["A"], dict):
            b["components"]["schemas"]["A"]["properties"]["new"] = {"type": "array", "items": {"$ref": "#/components/schemas/A"}}
            b["components"]["schemas"]["A"]["required"] = ["new", "id"]
    base = spark.createDataFrame([(i, json.dumps(a), "x") for i, (a, _) in enumerate(pairs)] + [(97, None, "x"), (98, "{", "x"), (99, "{}", "x")], "doc int, body string, pointer string")
    head = spark.createDataFrame([(i, json.dumps(b)) for i, (_, b) in enumerate(pairs)] + [(97, "{}"), (98, "{}"), (100, "[]")], "doc int, body string")
    got = Counter((x.doc, x.impact, x.area, x.location, x.summary) for x in compare_documents(base, head, "body", ["doc"], follow).collect())
    assert got == Counter({(i, *f): n for i, (a, b) in enumerate(pairs) for f, n in plain(a, b, follow).items()})


def test_cycles_end_and_rules_follow_the_direction(spark):
    def doc(more):
        a = {"properties": {"next": {"$ref": "#/components/schemas/A"}, **more}, "required": list(more)}
        op = {"requestBody": {"content": {"j": {"schema": {"$ref": "#/components/schemas/A"}}}}, "responses": {"200": {"content": {"j": {"schema": {"$ref": "#/components/schemas/A"}}}}}}
        return json.dumps({"paths": {"/a": {"post": op}}, "components": {"schemas": {"A": a}}})

    base, head = (spark.createDataFrame([(1, doc(m))], "doc int, body string") for m in ({}, {"x": {"type": "string"}}))
    found = {(f.area, f.impact, f.location) for f in compare_documents(base, head, "body", ["doc"], True).collect()}
    assert found == {("openapi.requestBody", "breaking", "POST /a requestBody.j.x"), ("openapi.responses", "additive", "POST /a responses.200.j.x"), ("openapi.schemas", "breaking", "components.schemas.A.x")}
    assert {f.area for f in compare_documents(base, head, "body", ["doc"]).collect()} == {"openapi.schemas"}


def odd_document(r):
    """What random documents lack: repeated operations and names, equal numbers of other kinds, references below components, schemas that are none."""
    some = lambda: r.choice([{"type": "string"}, {"enum": [1]}, {"enum": [1.0]}, {"enum": [True]}, "odd", 1, True, {"$ref": "#/components/schemas/A/properties/p"}, {"$ref": "#/components/schemas/B/items"}, {"$ref": "#/components/schemas/~2"}, {"$ref": "#/components/schemas/A"}, {"properties": {"": {}, "p": 1}}])
    schema = lambda: {"properties": {n: some() for n in r.sample(["p", "q", ""], 2)}, "items": some(), "required": r.choice([["p", 1, True], ["q"], "p"])}
    content = lambda *media: {"content": {m: {"schema": r.choice([schema(), some()])} for m in media}}
    ops = {m: {"requestBody": content("j"), "responses": {"200": content("x", "a.b"), "200.a": content("b")}} for m in r.sample(["get", "GET", "post"], 2)}
    return {"paths": {"/a": ops}, "webhooks": {"w": {"post": ops.get("post", {})}}, "components": {"schemas": {n: r.choice([schema(), "odd", 1, 1.0, True]) for n in r.sample(["A", "B", "~2", ""], 3)}}}


@pytest.mark.parametrize("follow", [False, True])
def test_documents_compared_whole_and_node_by_node_tell_the_same(spark, monkeypatch, follow):
    r = random.Random(5)
    pairs = [(make(r), make(r)) for make in [odd_document] * 60 + [random_document] * 20]
    base, head = (spark.createDataFrame([(i, json.dumps(p[side])) for i, p in enumerate(pairs) if i % 30 != side], "doc int, body string") for side in (0, 1))
    read = lambda: Counter(tuple(x) for x in compare_documents(base, head, "body", ["doc"], follow).collect())
    whole = read()
    for chars in (0, 900):  # all, and some, node by node
        monkeypatch.setattr(schema_graph, "WHOLE_CHARS", chars)
        assert read() == whole
    assert sum(whole.values()) > 500


def test_documents_meet_once_and_nest_at_will(spark, monkeypatch):
    saved, save = {}, Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))

    def deep(kind):
        node = {"type": kind}
        for _ in range(schema_graph.MAX_LEVELS + 50):
            node = {"properties": {"a": node}}
        return json.dumps({"components": {"schemas": {"A": node}}})

    found = compare_documents(*[spark.createDataFrame([(1, deep(k))], "doc int, body string") for k in ("string", "integer")], "body", ["doc"], True).collect()
    assert [(x.summary, x.location.count(".a")) for x in found] == [("schema changed", schema_graph.MAX_LEVELS + 50)]
    assert "pairs1" not in saved and not any(saved[name].count() for name in saved)
