"""Derivations over references against a reader that walks each document in plain Python."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import pytest

from attestor.operators import derivations as d

METHODS = {"get", "put", "post", "delete", "options", "head", "patch", "trace"}


def esc(s):
    return s.replace("~", "~0").replace("/", "~1")


def dump(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def target(v):
    name = v[len("#/components/schemas/") :] if isinstance(v, str) and v.startswith("#/components/schemas/") else ""
    return name.replace("~1", "/").replace("~0", "~") if name and "/" not in name else None


def is_array(v):
    return isinstance(v, dict) and v.get("type") == "array"


def below(node, field):
    """(tail of pointer, field, node) of a property and all that stands below it by properties and items."""
    yield "", field, node
    if isinstance(node, dict):
        for k, v in node.items():
            if k == "items":
                for tail, f, n in below(v, f"{field}[]"):
                    yield f"/items{tail}", f, n
            if k == "properties" and isinstance(v, dict):
                for name, sub in v.items():
                    if name:
                        for tail, f, n in below(sub, f"{field}.{name}"):
                            yield f"/properties/{esc(name)}{tail}", f, n


def plain(doc):
    out = set()
    for path, item in doc.get("paths", {}).items():
        for m, op in item.items():
            at = f"/paths/{esc(path)}/{m}"
            if m not in METHODS or not path.startswith("/"):
                continue
            out |= {("openapi_path_from_pointer", None, "/path", dump(path), (at,)), ("openapi_method_from_pointer", None, "/method", dump(m.upper()), (at,))}
            for status, answer in op.get("responses", {}).items():
                if status == "default" or len(status) == 3 and status[0] in "12345" and (status[1:] == "XX" or status[1:].isdigit()):
                    out.add(("openapi_response_status_from_pointer", None, f"/responses/{status}/status_code", dump(status), (f"{at}/responses/{status}",)))
                    for media, c in answer.get("content", {}).items():
                        if target(c["schema"].get("$ref")):
                            out.add(("openapi_schema_name_from_ref", None, f"/responses/{status}/schema_ref", dump(target(c["schema"]["$ref"])), (f"{at}/responses/{status}/content/{esc(media)}/schema/$ref",)))
            for media, c in op.get("requestBody", {}).get("content", {}).items():
                if target(c["schema"].get("$ref")):
                    out.add(("openapi_request_schema_name_from_ref", None, "/request_schema_ref", dump(target(c["schema"]["$ref"])), (f"{at}/requestBody/content/{esc(media)}/schema/$ref",)))
    schemas = doc.get("components", {}).get("schemas", {})
    place = lambda s: f"/components/schemas/{esc(s)}"
    for s, schema in schemas.items():
        out.add(("openapi_schema_name_from_pointer", s, "/name", dump(s), (place(s),)))
        if not isinstance(schema, dict):
            continue
        listed = schema.get("required", [])
        good = isinstance(listed, list) and all(isinstance(x, str) for x in listed)
        for name, node in (schema.get("properties") or {}).items():
            mark = "[]" if is_array(node) else ""
            if good and isinstance(node, dict) and (mark or not name.endswith("[]")):
                if "." not in name:
                    out.add(("openapi_request_body_property_required_from_schema_pointer", s, f"/parameters/body/{esc(name + mark)}/required", dump(name in listed), (place(s),)))
                out.add(("openapi_schema_property_required_from_schema_pointer", s, f"/fields/{esc(name + mark)}/required", dump(name in listed), (place(s),)))
            for tail, field, sub in below(node, ""):
                at, last = f"{place(s)}/properties/{esc(name)}{tail}", "[]" if is_array(sub) else ""
                out.add(("openapi_request_body_property_name_from_pointer", s, f"/parameters/body/{esc(name + last + field)}/name", dump(name + last + field), (at,)))
                if isinstance(sub, dict) and isinstance(sub.get("type", ""), str):
                    out.add(("openapi_schema_property_name_from_pointer", s, f"/fields/{esc(name + field + last)}/name", dump(name + field + last), (at,)))
                    if "type" in sub:
                        out.add(("openapi_schema_property_type_from_pointer", s, f"/fields/{esc(name + field + last)}/type", dump(sub["type"]), (at,)))
    hops = []
    for s, schema in schemas.items():
        for name, node in (schema.get("properties") or {}).items() if isinstance(schema, dict) else ():
            at = f"{place(s)}/properties/{esc(name)}"
            if isinstance(node, dict) and target(node.get("$ref")):
                hops.append((s, name, False, target(node["$ref"]), f"{at}/$ref"))
            if isinstance(node, dict) and isinstance(node.get("items"), dict) and target(node["items"].get("$ref")):
                hops.append((s, name, True, target(node["items"]["$ref"]), f"{at}/items/$ref"))
    for s, name, array, to, at in hops:
        schema = schemas.get(to)
        if not isinstance(schema, dict):
            continue
        listed = schema.get("required", [])
        good = isinstance(listed, list) and all(isinstance(x, str) for x in listed)
        for child, node in (schema.get("properties") or {}).items():
            mark, own = "[]" if is_array(node) else "", f"{place(to)}/properties/{esc(child)}"
            field = f"{name}{'[]' if array else ''}.{child}{mark}"
            typed, fits = isinstance(node, dict) and isinstance(node.get("type", ""), str), mark or not child.endswith("[]")
            needed = good and isinstance(node, dict) and fits
            if array:
                out.add(("openapi_request_body_ref_property_name_from_fragments", s, f"/parameters/body/{esc(field)}/name", dump(field), (own, at)))
            if needed and "." not in name and "." not in child:
                if array:
                    out.add(("openapi_request_body_ref_property_required_from_fragments", s, f"/parameters/body/{esc(field)}/required", dump(child in listed), (place(to), at)))
                out.add(("openapi_schema_ref_property_required_from_fragments", s, f"/fields/{esc(field)}/required", dump(child in listed), (place(to), at)))
            if typed:
                out.add(("openapi_schema_ref_property_name_from_fragments", s, f"/fields/{esc(field)}/name", dump(field), (own, at)))
                if "type" in node:
                    out.add(("openapi_schema_ref_property_type_from_fragments", s, f"/fields/{esc(field)}/type", dump(node["type"]), (own, at)))
            for top, above, outer, through, first in hops:
                if through == s and outer and array:
                    far = f"{above}[].{field}"
                    if typed and fits:
                        out.add(("openapi_schema_two_hop_ref_property_name_from_fragments", top, f"/fields/{esc(far)}/name", dump(far), (own, first, at)))
                        if "type" in node:
                            out.add(("openapi_schema_two_hop_ref_property_type_from_fragments", top, f"/fields/{esc(far)}/type", dump(node["type"]), (own, first, at)))
                    if needed:
                        out.add(("openapi_schema_two_hop_ref_property_required_from_fragments", top, f"/fields/{esc(far)}/required", dump(child in listed), (place(to), first, at)))
    return out


def random_document(r):
    names, props = ["A", "B/x", "C~y", "D"], ["id", "a.b", "list[]", "é/x", "n~1"]

    def node(depth=0):
        ref = {"$ref": f"#/components/schemas/{esc(r.choice(names))}"}
        pick = r.random()
        if pick < 0.3:
            return ref
        if pick < 0.55:
            return {"type": "array", "items": ref if r.random() < 0.7 or depth > 1 else node(depth + 1)}
        if pick < 0.65 and depth < 2:
            return {"type": "object", "properties": {r.choice(props): node(depth + 1) for _ in range(2)}, "items": {}}
        return r.choice([{"type": "string"}, {"type": 3}, {"type": ["a"]}, {}, "odd", {"type": "integer", "x": None}, {"$ref": "other.json#/x"}])

    schemas = {}
    for n in names:
        schemas[n] = {"properties": {r.choice(props): node() for _ in range(4)}} | r.choice([{}, {"required": ["id", "a.b", "é/x"]}, {"required": "id"}, {"required": [1]}, {"required": []}])
    schemas["D"] = r.choice([schemas["D"], "odd", {}])
    ref = {"schema": {"$ref": f"#/components/schemas/{esc(r.choice(names))}"}}
    op = {"requestBody": {"content": {"application/json": ref}}, "responses": {r.choice(["200", "2XX", "default", "99", "2xx"]): {"content": {"a/b": ref, "c": {"schema": {"$ref": "#/else"}}}}}}
    return {"paths": {r.choice(["/a/{b}", "c", "/~x"]): {r.choice(["get", "post", "parameters"]): op}}, "components": {"schemas": schemas}}


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(8)
    docs = [random_document(r) for _ in range(80)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)] + [(900, None), (901, "{"), (902, "[]"), (903, "{}")], "document int, body string")
    nodes = d.json_nodes(df, "body", ["document"]).cache()
    return docs, nodes, d.derivable_claims(nodes).cache()


def test_every_claim_and_no_other(made):
    docs, _, derivable = made
    want = {(i, *c) for i, doc in enumerate(docs) for c in plain(doc)}
    got = [(x.document, x.derivation, x.scope, x.claim_path, x.value, tuple(x.inputs)) for x in derivable.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {c[1] for c in want} == {*d.NO_HOP, *d.ONE_HOP, *d.TWO_HOPS}


def test_each_derivation_is_accepted_and_refused(spark, made):
    docs, nodes, derivable = made
    values = {(x.document, x.pointer): x.value for x in nodes.collect()}

    def digest(doc, pointer):
        return hashlib.sha256(dump({"locator": {"kind": "json_pointer", "pointer": pointer}, "semantic_value": json.loads(values[doc, pointer])}).encode()).hexdigest()

    one = {}
    for i, doc in enumerate(docs):
        for c in sorted(plain(doc), key=str):
            one.setdefault(c[0], (i, *c))
    rows, want = [], []

    def support(reason, i, name, about, path, value, given, **change):
        row = {"id": len(rows), "document": i, "n_steps": 1, "derivation": name, "version": "1", "scope": about or "any", "claim_path": path, "claim_value": value, "inputs": list(given), "context_docs": [i] * (len(given) - 1), "structured": True,
               "input_digests": [digest(i, p) for p in given], "output_digest": hashlib.sha256(value.encode()).hexdigest()} | change
        rows.append(row)
        want.append(reason)

    for c in one.values():
        _, name, scope, path, value, inputs = c
        support("OPENAPI_POINTER_DERIVATION_MATCH", *c)
        support("DERIVATION_OUTPUT_MISMATCH", *c, output_digest="x")
        support("DERIVATION_VALUE_MISMATCH", *c, claim_value='"other"')
        support("DERIVATION_INPUT_MISMATCH", *c, input_digests=["x"] * len(inputs))
        support("DERIVATION_CHAIN_INVALID", *c, n_steps=2)
        support("DERIVATION_NOT_ALLOWED", *c, version="2")
        support("DERIVATION_STEPS_REQUIRED", *c, n_steps=0)
        support("DERIVATION_INAPPLICABLE", *c, structured=False)
        support("DERIVATION_INAPPLICABLE" if "required" in name or "two_hop" in name else "DERIVATION_CLAIM_PATH_MISMATCH", *c, claim_path="/else")
        support("DERIVATION_CONTEXT_INVALID", *c, inputs=[*inputs, "/third"], context_docs=[c[0]] * len(inputs))  # one reference more than it takes
        if len(inputs) > 1:
            support("DERIVATION_CONTEXT_ARTIFACT_MISMATCH", *c, context_docs=[-1] * (len(inputs) - 1))
        if scope:
            support("DERIVATION_INAPPLICABLE", *c, scope="another")
    for name in d.PLAIN:
        support("DERIVATION_ALLOWED", 0, name, None, "/x", '"v"', [])
        support("DERIVATION_OUTPUT_MISMATCH", 0, name, None, "/x", '"v"', [], output_digest="x")
    kinds = "id int, document int, n_steps int, derivation string, version string, scope string, claim_path string, claim_value string, inputs array<string>, context_docs array<int>, structured boolean, input_digests array<string>, output_digest string"
    supports = spark.createDataFrame([tuple(x.values()) for x in rows], kinds)
    got = {x.id: x.reason for x in d.verify_derivations(supports, derivable).collect()}
    assert [(rows[i]["derivation"], got[i]) for i in range(len(rows))] == [(x["derivation"], w) for x, w in zip(rows, want, strict=True)]
    assert len({x["derivation"] for x in rows}) == 22


def test_claims_of_whole_documents_are_those_of_their_nodes(spark):
    r = random.Random(21)
    docs = [random_document(r) for _ in range(60)]
    ref = "#/components/schemas/"
    for doc in docs[:40]:  # arrays for objects, odd names, types and references
        for schema in doc["components"]["schemas"].values():
            if isinstance(schema, dict) and "properties" in schema:
                schema["properties"] |= {
                    "": {"type": "array", "items": [{"properties": {"x": {}}}]}, "t": {"type": None}, "l": {"properties": [{"type": "string"}, 1], "items": 2}, "z": {"items": {"properties": {"": {"properties": {"y": {}}}}}},
                    r.choice(["a", "b/c"]): {"$ref": r.choice([ref, ref + ref + "A", ref + "C~2", ref + "A/properties", ref + "\"\\é"]), "items": {"$ref": ref + "A"}}, '"\\é\t': {"type": '"'},
                }
        if r.random() < 0.3:
            doc["components"]["schemas"] = r.choice([list(doc["components"]["schemas"].values()), {"A": {"properties": [{"$ref": ref + "A"}]}, '"\\é': {"required": ["x", "x"], "properties": {"x": None, "y": {}}}}])
        if r.random() < 0.3:
            doc["paths"] = {"/p": {"get": r.choice([3, {"responses": ["x"]}, {"responses": {"200": {"content": [{"schema": {"$ref": ref + "A"}}]}, "default": None}}])}, "": {"get": {}}}
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)] + [(900, None), (901, "{"), (902, "[]"), (903, "{}"), (904, "3")], "document int, body string")
    found = d.document_claims(df, "body", ["document"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = d.derivable_claims(d.json_nodes(df, "body", ["document"])).select("document", "derivation", "scope", "claim_path", "value")
    got = Counter(map(tuple, found.collect()))
    assert got == Counter(map(tuple, want.collect())) and sum(got.values()) > 3000
