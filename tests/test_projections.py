"""Documents written from contract tables against plain builders, byte for byte."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest

from attestor.operators import projections as p
from attestor.session import Workspace

KINDS = {
    "contracts": "title string, version string", "environments": "ord int, name string, servers array<string>", "schemas": "ord int, name string",
    "fields": "schema string, ord int, name string, type string, schema_ref string, required boolean", "operations": "method string, path string, summary string, request_schema_ref string, security array<string>",
    "parameters": "method string, path string, ord int, name string, location string, required boolean, schema_ref string", "responses": "method string, path string, status string, description string, schema_ref string",
    "security": "name string, type string",
}


def made(r):
    rows = {k: [] for k in KINDS}
    for c in range(25):
        rows["contracts"].append((c, r.choice(["Töst \"x\"", "", "a\nb"]), r.choice([None, "2.0", ""])))
        rows["environments"] += [(c, i, f"env{i}", ["https://x", "https://y/é"][: r.randint(0, 2)]) for i in range(r.randint(0, 2))]
        names = r.sample(["A", "b.c", "Z_1", "a-d"], r.randint(0, 4))
        rows["schemas"] += [(c, i, n) for i, n in enumerate(names)]
        for n in names:
            rows["fields"] += [(c, n, i, f, r.choice([None, "string", ""]), r.choice([None, "A", "x/y~"]), r.choice([True, False, None])) for i, f in enumerate(r.sample(["id", "é", "a/b", '"q"'], r.randint(0, 4)))]
        for m, path in {(r.choice(["GET", "post"]), r.choice(["/a", "/a/{b}", "/é"])) for _ in range(r.randint(0, 4))}:
            rows["operations"].append((c, m, path, r.choice([None, "", "Say \"hi\""]), r.choice([None, "A"]), r.choice([[], ["k", "l"], None])))
            rows["parameters"] += [(c, m, path, i, f"p{i}", "query", r.choice([True, False, None]), r.choice([None, "A"])) for i in range(r.randint(0, 12))]
            rows["responses"] += [(c, m, path, s, r.choice([None, "ok | no"]), r.choice([None, "A"])) for s in r.sample(["200", "404", "default"], r.randint(0, 3))]
        rows["security"] += [(c, "k", "apiKey")] * r.randint(0, 1)
    return rows


def ref(name):
    return {"$ref": "#/components/schemas/" + name.replace("~", "~0").replace("/", "~1")}


def plain(rows, c):
    mine = {k: [x[1:] for x in v if x[0] == c] for k, v in rows.items()}
    (title, version), paths = mine["contracts"][0], {}
    for m, path, summary, body, security in mine["operations"]:
        op = {"responses": {}} | ({"summary": summary} if summary else {}) | ({"requestBody": {"content": {"application/json": {"schema": ref(body)}}}} if body else {}) | ({"security": [{n: []} for n in security]} if security else {})
        params = [{"name": n, "in": at} | ({} if q is None else {"required": q}) | ({"schema": ref(s)} if s else {}) for a, b, _, n, at, q, s in mine["parameters"] if (a, b) == (m, path)]
        if params:
            op["parameters"] = params
        for a, b, status, said, s in mine["responses"]:
            if (a, b) == (m, path):
                op["responses"][status] = {"description": said or ""} | ({"content": {"application/json": {"schema": ref(s)}}} if s else {})
        paths.setdefault(path, {})[m.lower()] = op
    schemas = {}
    for _, name in mine["schemas"]:
        fields = [x[1:] for x in mine["fields"] if x[0] == name]
        needed = [n for _, n, _, _, q in fields if q]
        schemas[name] = {"type": "object", "properties": {n: ref(s) if s else {"type": k} if k else {} for _, n, k, s, _ in fields}} | ({"required": needed} if needed else {})
    info = {"title": title, "version": version or "0.0.0"} | ({"x-loop-status": "missing-source"} if version is None else {})
    servers = [{"url": u, "description": n} for _, n, us in mine["environments"] for u in us]
    out = {"openapi": "3.1.0", "info": info, "servers": servers, "paths": paths, "components": {"schemas": schemas, "securitySchemes": {n: {"type": k} for n, k in mine["security"]}}}
    return json.dumps(out, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@pytest.fixture(scope="module")
def tables(spark):
    rows = made(random.Random(5))
    return rows, {k: spark.createDataFrame(v, f"contract int, {KINDS[k]}") for k, v in rows.items()}


def test_openapi_byte_for_byte(tables):
    rows, frames = tables
    got = {x.contract: (x.content, x.error) for x in p.openapi_documents(frames).collect()}
    assert got == {c: (plain(rows, c), None) for c, *_ in rows["contracts"]}


def test_refusals(spark, tables):
    rows, frames = tables
    more = spark.createDataFrame([(0, 9, "no good"), (1, 9, "ok")], "contract int, ord int, name string")
    op = [(2, "get", "/twice", None, None, []), (2, "GET", "/twice", None, None, []), (3, "GET", "/once", None, None, [])]
    others = spark.createDataFrame([(4, "graphql", "", "", None, None, None), (5, "http", "PUT", "/more", "s", None, ["k"])], f"contract int, transport string, {KINDS['operations']}")
    changed = frames | {"schemas": frames["schemas"].unionAll(more), "operations": frames["operations"].unionAll(spark.createDataFrame(op, f"contract int, {KINDS['operations']}")), "interactions": others}
    got = {x.contract: x for x in p.openapi_documents(changed).collect()}
    assert {c: x.error for c, x in got.items() if x.error} == {0: "invalid component name no good", 2: "two operations on GET /twice", 4: "unsupported transport graphql"}
    assert all((x.content is None) == (x.error is not None) for x in got.values()) and '"put":{"responses":{},"security":[{"k":[]}],"summary":"s"}' in got[5].content


def test_graphql_text_and_refusals(spark, tables):
    _, frames = tables
    others = [(0, "graphql", "mutation", "b", "A", True), (0, "graphql", "query", "z", "A", False), (0, "graphql", "query", "a", "A", None), (1, "graphql", "query", "a", None, None), (2, "graphql", "query", "a", "No", None), (3, "graphql", "query", "a", "A", None), (3, "graphql", "query", "a", "A", None), (4, "http", None, None, None, None)]
    schemas = [(c, 0, "A") for c in range(7)] + [(0, 1, "B")]
    fields = [(0, "A", 0, "x", "Int", None, True), (0, "A", 1, "b", "Int", "B", False), (5, "A", 0, "x", None, None, None)]
    change = {"interactions": spark.createDataFrame(others, "contract int, transport string, operation_kind string, root_field string, output_schema_ref string, output_required boolean"), "schemas": spark.createDataFrame(schemas, "contract int, ord int, name string"), "fields": spark.createDataFrame(fields, f"contract int, {KINDS['fields']}")}
    got = {x.contract: x for x in p.graphql_documents(frames | change).collect()}
    assert got[0].content == "type Query {\n  a: A\n  z: A\n}\n\ntype Mutation {\n  b: A!\n}\n\ntype A {\n  b: B\n  x: Int!\n}\n\ntype B {\n\n}\n"
    assert [got[c].error for c in range(1, 6)] == ["no output schema", "unresolved output schema No", "two interactions on query a", "unsupported transport http", "no type of A.x"]
    assert got[6].content == "type A {\n\n}\n" and got[9].content == ""


def test_fold_of_nested_arrays_and_markers(spark):
    rows = [(1, ["ka", "i000000000002"], "2"), (1, ["ka", "i000000000010"], "10"), (1, ["ka", "i000000000001", "kx", ""], "[]"), (1, ["kb", ""], "{}"), (1, ["kb", "kc"], "null"), (1, ["kb", ""], "{}"), (2, [], "7"), (3, [""], "[]")]
    df = spark.createDataFrame(rows, "id int, path array<string>, value string")
    got = {x.id: x.json for x in p.fold_json(df, ["id"], Workspace(spark, "fold")).collect()}
    assert got == {1: '{"a":[{"x":[]},2,10],"b":{"c":null}}', 2: "7", 3: "[]"}


def test_a_contract_meets_once_whatever_its_paths(spark, tables):
    rows, frames = tables
    first = rows["contracts"][0][0]
    twice = spark.createDataFrame([*rows["contracts"], rows["contracts"][0], (None, None, None)], frames["contracts"].schema)
    found = p.openapi_documents(frames | {"contracts": twice})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
    got = Counter((x.contract, x.content, x.error) for x in found.collect())
    assert got == Counter({(None, None, None): 1} | {(c, plain(rows, c), None): 1 + (c == first) for c, *_ in rows["contracts"]})


def test_fold_of_odd_steps_and_values(spark):
    rows = [
        (1, ["ka"], "1"), (1, ["ka", "kb"], "2"), (1, ["ka"], None), (2, ["ka", None], "1"), (2, ["ka", "", "kb"], "1"), (3, [None], "1"), (4, None, "1"), (5, ["kx", "k"], None), (5, ["kx", "k\x1f\\u001f"], "{}"),
        (6, [], "1"), (6, ["ka"], "2"), (7, ["i01"], "1"), (7, ["ka"], "2"), (8, ["ka", ""], "[]"), (8, ["ka", "kb"], "3"), (None, ["ka"], "9"), (None, ["ka"], "8"),
    ]
    got = {x.id: x.json for x in p.fold_json(spark.createDataFrame(rows, "id int, path array<string>, value string"), ["id"]).collect()}
    assert got == {1: '{"a":{"b":2}}', 2: '{"a":[]}', 3: "[]", 5: '{"x":{"\\u001F\\\\u001f":{}}}', 6: '{"a":2}', 7: '{"01":1,"a":2}', 8: '{"a":[3]}', None: '{"a":9}'}
