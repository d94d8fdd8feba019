"""Plans: details met with endpoints, keys, nested names, items."""

from __future__ import annotations

import random

from attestor.operators import planning


def test_details_join_the_first_endpoint_or_each_other(spark):
    ends = spark.createDataFrame([(1, 0, " get", "/a"), (1, 1, "GET", "/a"), (1, 2, "POST", "/a"), (2, 0, "GET", "/b"), (1, 3, "GET", None)], "run int, ord int, method string, path string")
    asked = spark.createDataFrame([(1, 0, "Get ", "/a"), (1, 1, "GET", "/a"), (1, 2, "PUT", "/a"), (1, 3, "put", "/a"), (2, 0, "GET", "/a"), (1, 4, None, "/a"), (1, 5, "GET", None)], "run int, ord int, method string, path string")
    got = {(r.run, r.detail): (r.endpoint, r.added) for r in planning.match_details(ends, asked).collect()}
    assert got == {(1, 0): (0, None), (1, 1): (0, None), (1, 2): (None, 2), (1, 3): (None, 2), (2, 0): (None, 0)}


def test_webhooks_pair_by_locator_then_source(spark):
    r = random.Random(5)
    ends = [(run, i, r.choice(["POST", "post", "PUT"]), None, r.sample(["l1", "l2", "l3", "l4"], r.randrange(3)), r.sample(["s1", "s2"], r.randrange(3))) for run in range(4) for i in range(6)]
    asked = [(run, i, r.choice(["POST", "PUT"]), None, r.choice(["l1", "l2", "l9", "", None]), r.choice(["s1", "s2", None])) for run in range(4) for i in range(8)]
    ends.append((0, 9, "POST", "/has/path", ["l1"], ["s1"]))
    want = {}
    for run in range(4):
        plan = [(o, None, m.lower(), set(ls), set(ss)) for q, o, m, p, ls, ss in ends if q == run and p is None]
        taken = set()
        for q, o, m, _, loc, src in asked:
            if q != run:
                continue
            free = [k for k in range(len(plan)) if k not in taken and plan[k][2] == m.lower()]
            hit = next((k for k in free if loc and loc in plan[k][3]), None)
            if hit is None:
                hit = next((k for k in free if src is not None and src in plan[k][4]), None)
            if hit is None:
                plan.append((None, o, m.lower(), {loc} - {None, ""}, {src} - {None}))
                want[str(run), o] = (None, o)
            else:
                taken.add(hit)
                want[str(run), o] = plan[hit][:2]
    e = spark.createDataFrame(ends, "run int, ord int, method string, path string, locators array<string>, sources array<string>")
    d = spark.createDataFrame(asked, "run int, ord int, method string, path string, locator string, source string")
    assert {(x.run, x.detail): (x.endpoint, x.added) for x in planning.match_webhooks(e, d).collect()} == want and len({v for v in want.values()}) > 10


def test_merged_fields_and_servers(spark):
    rows = [(1, "e", "parameters", "id|query", 2, "late"), (1, "e", "parameters", "id|query", 1, "early"), (1, "e", "responses", "200", 1, "ok"), (1, "e", "request", "x", 1, None), (1, "e", "request", "y", 2, "body"), (1, "e", "examples", "", 1, "a"), (1, "e", "examples", "", 2, "a"), (1, "e", "tags", "t", 1, "t")]
    got = sorted((r.kind, r.payload) for r in planning.merged_fields(spark.createDataFrame(rows, "run int, endpoint string, kind string, name string, ord int, payload string")).collect())
    assert got == [("examples", "a"), ("examples", "a"), ("parameters", "early"), ("request", "body"), ("responses", "ok"), ("tags", "t")]
    ends = spark.createDataFrame([(1, "GET", "/a", "s2"), (1, "get", "/a", "s1"), (1, "PUT", "/a", "s1"), (1, "PUT", "/a", None)], "run int, method string, path string, server string")
    assert [(r.method, r.servers) for r in planning.server_conflicts(ends).collect()] == [("get", ["s1", "s2"])]


def test_keys_stay_unique(spark):
    names = ["A (x)", "A (x)", "A__x", "A_x_2", "A_x", "取消（A）", None, "A_x_2"]
    rows = [(1, i, n) for i, n in enumerate(names)] + [(2, 0, "A x")]
    got = {(r.run, r.ord): r.key for r in planning.schema_keys(spark.createDataFrame(rows, "run int, ord int, name string")).collect()}
    assert [got[1, i] for i in range(8)] == ["A_x", "A_x_2", "A__x", "A_x_2_2", "A_x_3", "A", "schema6", "A_x_2_3"] and got[2, 0] == "A_x"
    hooks = [(1, 0, "POST", None, "Paid (now). More"), (1, 1, "POST", "", "Paid: later"), (1, 2, "POST", "/p", "Paid"), (1, 3, "POST", None, None), (1, 4, None, None, "Paid"), (1, 5, "POST", None, "Paid\nx"), (1, 6, "POST", None, "(all)")]
    got = {r.ord: r.key for r in planning.webhook_keys(spark.createDataFrame(hooks, "run int, ord int, method string, path string, summary string")).collect()}
    assert got == {0: "Paid", 1: "Paid2", 3: "webhook2", 5: "Paid3", 6: "(all)"}


def test_nested_names(spark):
    fields = [("o", 0, "A[].b", True, False), ("o", 1, "A.c", False, False), ("o", 2, "A", True, False), ("o", 3, "U", False, True), ("o", 4, "U.x", True, False), ("o", 5, "p.q.r", True, False), ("o", 6, "p..q.s", False, False), ("o", 7, "A.c", True, False), ("o", 8, "[]", True, False), ("x", 0, "A", False, False), ("o", 9, None, True, False)]
    got = {(r.owner, r.path): (r.parent, r.key, r.kind, r.required, r.leaf) for r in planning.nested_fields(spark.createDataFrame(fields, "owner string, ord int, name string, required boolean, is_union boolean")).collect()}
    assert got == {
        ("o", "A"): ("", "A", "array", True, 2), ("o", "A.b"): ("A", "b", "field", True, 0), ("o", "A.c"): ("A", "c", "field", True, 7), ("o", "U"): ("", "U", "union", False, 3), ("o", "p"): ("", "p", "object", False, None),
        ("o", "p.q"): ("p", "q", "object", False, None), ("o", "p.q.r"): ("p.q", "r", "field", True, 5), ("o", "p.q.s"): ("p.q", "s", "field", False, 6), ("x", "A"): ("", "A", "field", False, 0),
    }


def test_names_through_references(spark):
    names = spark.createDataFrame([("e", "Own"), ("s1", "One"), ("s2", "Two"), ("s3", "Three"), ("far", "Not")], "node string, name string")
    refs = spark.createDataFrame([("e", "s1"), ("s1", "s2"), ("s2", "s1"), ("s2", "s3"), ("s3", "gone")], "node string, to_node string")
    roots = spark.createDataFrame([("e",), ("f",), ("s3",)], "owner string")
    assert {(r.owner, r.name) for r in planning.reachable_names(names, refs, roots).collect()} == {("e", "own"), ("e", "one"), ("e", "two"), ("e", "three"), ("s3", "three")}


def test_plan_items(spark):
    item = "array<struct<source:string,missing:boolean,conflict:boolean,payload:string>>"
    answers = [(1, "05", "q1", [("A.md", False, False, "p0"), ("zz", False, False, "p1"), ("a.md", True, False, "p2"), (None, False, True, "p3")]), (1, "07", "q2", None), (2, "05", "q3", [("zz", False, False, "p4")])]
    docs = spark.createDataFrame([(1, "d1", "a.md"), (1, "d2", "b.md"), (2, "d3", "c.md")], "run int, document string, name string")
    rows = planning.plan_items(spark.createDataFrame(answers, f"run int, stage string, query_id string, items {item}"), docs).collect()
    got = {(r.run, r.payload): (r.status, r.source, r.area) for r in rows if r.ord >= 0}
    assert got == {(1, "p0"): ("supported", "d1", "endpoints"), (1, "p1"): ("unverified", None, "endpoints"), (1, "p2"): ("missing", "d1", "endpoints"), (1, "p3"): ("conflicting", None, "endpoints"), (2, "p4"): ("supported", None, "endpoints")}
    gaps = sorted((r.run, r.stage, r.payload) for r in rows if r.ord < 0)
    assert gaps == sorted([(1, "07", "malformed answer")] + [(run, s, "no structured answer") for run in (1, 2) for s in planning.STAGES if s != "05" and (run, s) != (1, "07")])


def test_integration_findings(spark):
    entries = spark.createDataFrame([(1, "crypto.a", "supported"), (1, "crypto.b", "conflicting"), (1, "crypto.c", "unverified"), (1, "crypto.d", "supported")], "run int, location string, status string")
    cites = spark.createDataFrame([(1, "crypto.a"), (1, "crypto.a"), (1, "crypto.b"), (1, "crypto.c")], "run int, location string")
    refs = spark.createDataFrame([(1, "callbacks.x", "op1"), (1, "callbacks.y", "op2")], "run int, location string, ref string")
    got = {(r.location, r.code) for r in planning.integration_findings(entries, cites, refs, spark.createDataFrame([(1, "op1"), (2, "op2")], "run int, ref string")).collect()}
    assert got == {("crypto.b", "SOURCE_CONFLICT"), ("crypto.c", "SOURCE_UNVERIFIED"), ("crypto.d", "UNSUPPORTED_ASSERTION"), ("callbacks.y", "OUTPUT_MISMATCH")}


def test_manifest_of_files_and_urls(spark):
    local = spark.createDataFrame([("a.md", "h1", "pending")], "path string, sha256 string, status string")
    urls = spark.createDataFrame([("https://x/y", "h2", 200)], "url string, content_sha256 string, http_status int")
    got = {r.document: (r.origin, r.sha256, r.status, r.http_status) for r in planning.build_manifest(local, urls).collect()}
    assert got == {"a.md": ("local", "h1", "pending", None), "https://x/y": ("url", "h2", None, 200)}
