"""What has to hold as tables grow: joins that are never broadcast, counts that keep repeats, groups that cost no call each."""

from __future__ import annotations

import json
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from attestor.functions.json_text import json_leaves
from attestor.operators import answers, claims, compare, conformance, derivations, domain, openapi, planning, projections, related
from attestor.operators.schema_graph import compare_documents
from attestor.plans import QUERIES
from attestor.session import Workspace
from attestor.sources import html


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_schemas_are_not_broadcast(spark, monkeypatch):
    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: (saved.append(plan(df)), save(self, df, name))[1])
    made = lambda n: json.dumps({"components": {"schemas": {"A": {"properties": {f"p{n}": {"$ref": "#/components/schemas/A"}, "q": {"$ref": "#/components/schemas/A"}}}}}})
    sides = [spark.createDataFrame([(1, made(n))], "id int, j string") for n in (0, 1)]
    for follow in (False, True):
        found = compare_documents(*sides, "j", ["id"], follow_refs=follow)
        assert {r.summary for r in found.collect()} == {"property removed", "optional property added"}
        assert "Broadcast" not in plan(found)
    assert sum("SortMergeJoin" in p for p in saved) >= 4 and not any("Broadcast" in p for p in saved)


def test_places_of_documents_are_not_broadcast(spark):
    leaves = json_leaves(spark.createDataFrame([(1, '{"a": {"$ref": "#/b"}}')], "id int, j string"), "j", ["id"])
    found = openapi.dangling_refs(leaves, ["id"])
    assert "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, "/a/$ref", "#/b")]


def test_proposals_count_observations_that_repeat_an_id(spark):
    rows = spark.createDataFrame([(7, 1, "/v", "x", "contradicts", False)] * 2 + [(8, 1, "/v", "x", "contradicts", False)], "id long, claim long, path string, observed string, relationship string, high_risk boolean")
    assert [tuple(r) for r in conformance.proposals(rows).collect()] == [(1, "/v", "x", [7, 8], 3)]


def test_documents_are_read_once_for_all_derivations(spark):
    doc = json.dumps({"components": {"schemas": {"A": {"properties": {"l": {"type": "array", "items": {"$ref": "#/components/schemas/A"}}}}}}})
    nodes = derivations.json_nodes(spark.createDataFrame([(i, doc) for i in range(3)], "id int, j string"), "j", ["id"])
    found = derivations.derivable_claims(nodes, "id")
    assert "Broadcast" not in plan(found) and "MapInArrow" not in plan(found)
    assert {r.claim_path for r in found.collect() if r.derivation in derivations.TWO_HOPS} == {"/fields/l[].l[].l[]/" + x for x in ("name", "type", "required")}


def test_groups_of_webhooks_are_read_in_a_stream(spark):
    e = [(run, 2 * i, "POST", None, ["l"], ["s"]) for run in range(5) for i in range(3)]
    d = [(run, 2 * i + 1, "post", None, "l" if i % 2 else "x", "s") for run in range(5) for i in range(4)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = planning.match_webhooks(
            spark.createDataFrame(e, "run long, ord long, method string, path string, locators array<string>, sources array<string>"), spark.createDataFrame(d, "run long, ord long, method string, path string, locator string, source string")
        )
        assert "InPandas" not in plan(found)
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == sorted((str(run), *x) for run in range(5) for x in ((1, 0, None), (3, 2, None), (5, 4, None), (7, None, 7)))


def test_an_operation_is_one_leaf(spark, monkeypatch):
    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: saved.append(save(self, df, name)) or saved[-1])
    empty = lambda columns: spark.createDataFrame([], "contract int, " + columns)
    found = projections.openapi_documents({
        "contracts": spark.createDataFrame([(1, "t", "1")], "contract int, title string, version string"), "environments": empty("ord int, name string, servers array<string>"), "schemas": empty("name string"),
        "fields": empty("schema string, ord int, name string, type string, schema_ref string, required boolean"), "security": empty("name string, type string"),
        "operations": spark.createDataFrame([(1, "GET", "/a", "s", "R", ["k"])], "contract int, method string, path string, summary string, request_schema_ref string, security array<string>"),
        "parameters": spark.createDataFrame([(1, "get", "/a", i, f"q{i}", "query", True, "R") for i in (10, 9)], "contract int, method string, path string, ord int, name string, location string, required boolean, schema_ref string"),
        "responses": spark.createDataFrame([(1, "GET", "/a", s, None, "R") for s in ("404", "200")], "contract int, method string, path string, status string, description string, schema_ref string"),
    })
    ref, schema = '{"$ref":"#/components/schemas/R"}', '"content":{"application/json":{"schema":{"$ref":"#/components/schemas/R"}}}'
    ask = ",".join(f'{{"in":"query","name":"q{i}","required":true,"schema":{ref}}}' for i in (9, 10))
    answers = ",".join(f'"{s}":{{{schema},"description":""}}' for s in (200, 404))
    want = f'"paths":{{"/a":{{"get":{{"parameters":[{ask}],"requestBody":{{{schema}}},"responses":{{{answers}}},"security":[{{"k":[]}}],"summary":"s"}}}}}}'
    assert want in found.first().content
    assert saved[0].where("path[0] = 'kpaths' and path[1] != ''").count() == 1


def test_claims_meet_their_counts_once(spark):
    claims = spark.createDataFrame([(1, "a", "i", "supported"), (1, "a", "j", "unverified"), (None, "a", "k", "supported"), (2, "a", "l", "supported")], "run int, location string, identity string, status string")
    proof = [(1, "a", "r", "explicit_support", "p"), (1, "a", None, "explicit_support", "q"), (1, "a", "r", "contradicts", None), (None, "a", "r", "explicit_support", "p"), (2, "a", "r", "derived_support", "p"), (3, "a", "r", "contradicts", "p")]
    paths = spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (2, "a", "p"), (None, "a", "p")], "run int, location string, path string")
    found = domain.claim_findings(claims, spark.createDataFrame(proof, "run int, location string, relationship_id string, relationship string, claim_path string"), paths)
    assert plan(found).count("Join") == 1
    got = sorted((r.run or 0, r.code, r.message) for r in found.collect())
    assert got == [(0, "CLAIM_EVIDENCE_REQUIRED", "k"), (0, "CLAIM_SEMANTIC_SUPPORT_REQUIRED", "k"), (1, "CLAIM_EVIDENCE_CONTRADICTS", "i"), (1, "CLAIM_EVIDENCE_CONTRADICTS", "j"), (1, "CLAIM_SUPPORT_COVERAGE_INCOMPLETE", "i")]


def test_equal_parts_are_counted_before_they_meet(spark):
    rows = lambda *values: spark.createDataFrame([("schema", "k", v, True) for v in values] + [("body", None, "x", True)] * 2, "kind string, key string, value string, required boolean")
    found = compare.compare_parts(rows("x", "x", "y"), rows("x", "z", "z"))
    assert "Aggregate" in plan(found)
    assert sorted(Counter(r.summary for r in found.collect()).items()) == [("body added", 2), ("body removed", 2), ("schema changed", 7)]


def test_a_finding_of_many_pairs_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK", 100)
    rows = lambda n, value: spark.range(n).select(F.lit("schema").alias("kind"), F.lit("k").alias("key"), F.concat(F.lit(value), F.col("id") % 2).alias("value"), F.lit(True).alias("required"))
    found = compare.compare_parts(rows(30, "x"), rows(71, "y"))
    sizes = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30 * 71 and max(sizes) <= 30 * 71 // 2
    assert {tuple(x) for x in found.collect()} == {("breaking", "schema", "k", "schema changed")}


def test_pages_alike_meet_as_one(spark):
    n, k = 60, 3
    branch = lambda i: None if i == 11 else ("A" if i % 2 else "a") if i % 5 else "b"
    has = {i: {"hot"} | ({"rare", f"x{i % 4}"} if i % 7 == 0 else set()) if i != 13 else set() for i in range(n)}
    links = {(i, (i * 3) % 50) for i in range(0, n, 2)} | {(5, 5), (4, 999), (7, 6), (6, 7)}
    df = {e: sum(e in s for s in has.values()) for e in set().union(*has.values())}
    low = lambda i: branch(i) and branch(i).lower()
    want = []
    for t in range(n):
        score = {p: sum(max(5, 60 // df[e]) for e in has[t] & has[p]) + 20 * (low(t) is not None and low(t) == low(p)) + 100 * ((t, p) in links) + 80 * ((p, t) in links) for p in range(n) if p != t}
        want += [(t, p, s, r) for r, (p, s) in enumerate(sorted(((p, s) for p, s in score.items() if s), key=lambda x: (-x[1], x[0]))[:k], 1)]
    table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    found = related.related_pages(
        table([(i, branch(i)) for i in range(n)], "page long, branch string"), table(links, "page long, to_page long"), table([(i, e) for i in range(n) for e in [*has[i]] * 2], "page long, entity string"), table([(i,) for i in range(n)], "target long"), k
    )
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_pages_alike_are_not_paired(spark, monkeypatch):
    saved, save = {}, Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    pages = spark.range(500).select(F.col("id").alias("page"), F.lit("a").alias("branch"))
    found = related.related_pages(pages, pages.selectExpr("page", "page + 1 as to_page"), pages.selectExpr("page", "'hot' as entity"), pages.selectExpr("page as target"), 5)
    assert found.count() == 2500
    assert saved["shared"].count() == 1


def test_nested_fields_are_dealt_out_once_and_names_sort_as_trees(spark):
    r = random.Random(3)
    names = [".".join(r.choice(["a", "a-b", "a/", "b", "b[]", "", "ab", "a "]) for _ in range(r.randint(1, 4))) for _ in range(120)]
    rows = [(i % 4, i, name, r.random() < 0.5, r.random() < 0.2) for i, name in enumerate(names)]
    found = planning.nested_fields(spark.createDataFrame(rows, "owner int, ord int, name string, required boolean, is_union boolean"))
    assert plan(found).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    position, arrays, leaf = {}, set(), {}
    for owner, i, name, required, union in rows:
        parts = name.split(".") if name else []
        keys = [p.removesuffix("[]") for p in parts]
        for level, key in enumerate(keys):
            if key:
                node = (owner, tuple(k for k in keys[: level + 1] if k))
                position.setdefault(node, (i, level))
                arrays |= {node} if parts[level].endswith("[]") else set()
                leaf |= {node: (i, required, union)} if level == len(keys) - 1 else {}
    unions = {n for n in position if leaf.get(n, (0, 0, False))[2]}
    want = set()
    for owner, keys in position:
        node = (owner, keys)
        if not any((owner, keys[:n]) in unions for n in range(1, len(keys))):
            inner = any(o == owner and len(k) == len(keys) + 1 and k[:-1] == keys for o, k in position)
            kind = "union" if node in unions else "field" if not inner else "array" if node in arrays else "object"
            at, required, _ = leaf.get(node, (None, False, False))
            want.add((owner, ".".join(keys), ".".join(keys[:-1]), keys[-1], kind, required, at, position[node]))
    got = found.collect()
    assert {(*x[:7], tuple(x.position)) for x in got} == want and len(got) == len(want) > 50


def test_rows_are_dealt_out_before_their_tables_are_parsed(spark):
    found = plan(QUERIES["html_table_grid"](spark, "/root/testdata/sf0.001")).split("Initial Plan")[-1]
    assert "hashpartitioning(p_partkey" in found and found.index("EvalPython") < found.index("Exchange")


def test_pages_become_python_objects_a_slice_at_a_time(monkeypatch):
    held, most = [], []
    monkeypatch.setattr(html, "SLICE_BYTES", 100)
    build = pa.array
    monkeypatch.setattr(html.pa, "array", lambda x, *kind: (most.append(len(x)), build(x, *kind))[1])
    pages = [None, "", "x" * 60, "é" * 30, "y" * 300, "z", *["a"] * 250]
    got = html.each_page(build(pages), lambda p: (held.append(p), len(p or ""))[1], pa.int32())
    assert got.to_pylist() == [len(p or "") for p in pages] and held == pages and max(most) <= 100 and sum(most) == len(pages)
    assert html.each_page(build([], pa.string()), len, pa.int32()).to_pylist() == []


def test_amendments_meet_their_predecessors_once(spark):
    rows = [(1, None, "s", "d1", None), (2, 1, "s", "d2", "d1"), (3, 2, "t", "d3", "d2"), (4, 3, "t", "d4", "x"), (5, 9, "t", "d5", None), (6, 7, "s", None, "d7"), (7, 6, "s", "d7", None), (8, 6, "s", "d8", "d6")]
    rows += [(i, i - 1 if i > 100 else None, None, "d", "d") for i in range(100, 140)]
    found = claims.supersession_violations(spark.createDataFrame(rows, "id int, supersedes int, scope string, digest string, previous_digest string").withColumn("target", F.lit("t")))
    assert "Join" not in plan(found)
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(3, "OTHER_SCOPE"), (4, "DIGEST_MISMATCH"), (5, "SUPERSEDED_NOT_FOUND"), *[(i, "SUPERSESSION_CYCLE") for i in (6, 7)], (8, "DIGEST_MISMATCH"), (8, "SUPERSESSION_CYCLE")]


def test_objects_of_answers_are_cut_out_once(spark, monkeypatch):
    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: (saved.append(plan(df)), save(self, df, name))[1])
    rows = spark.createDataFrame([(1, "07", i, "q", '{"schemas": [{"name": "a"}], "missing": ["%d"]}' % i) for i in range(3)], "run int, stage string, ord int, query_id string, answer string")
    found = answers.coerced_items(rows, spark.createDataFrame([(1, "d", "n")], "run int, document string, name string"))
    assert "EvalPython" not in plan(found) and "max_by" not in plan(found)
    assert len(saved) == 1 and saved[0].split("Initial Plan")[-1].count("Exchange") == 1
    assert [r.detail for r in found.where("stage = '07'").orderBy("kind").collect()] == ["a", "2"]
