"""Operators over manifests, citations, findings and artifacts on small tables."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestor.operators import claims, manifest, related, validators
from attestor.sources import artifacts, html


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_directories(spark, tmp_path):
    for name, data in (("a.md", b"one"), ("sub/b.md", b"one"), ("sub/c.xyz", b"two"), ("README.md", b"no"), ("d.md", b"")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    files = manifest.scan_directory(spark, str(tmp_path))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert rows(files) == sorted([("a.md", 3, sha(b"one")), ("sub/b.md", 3, sha(b"one")), ("sub/c.xyz", 3, sha(b"two")), ("README.md", 2, sha(b"no"))])
    got = {r.path: (r.status, r.duplicate_of) for r in manifest.with_status(files).collect()}
    assert got == {"a.md": ("pending", None), "sub/b.md": ("duplicate", "a.md"), "sub/c.xyz": ("unsupported", None), "README.md": ("ignored", None)}


def test_authority(spark):
    files = spark.createDataFrame([("a.md", "h1"), ("b.md", "h2")], "path string, sha256 string")
    side = lambda *x: spark.createDataFrame(list(x), "path string, content string")
    good = json.dumps({"authority": "supplementary", "source_file": "a.md", "sha256": "h1"})
    assert rows(manifest.with_authority(files, side(("a.md.source.json", good))), "path", "authority") == [("a.md", "supplementary"), ("b.md", "normative")]
    for bad in ("no json", json.dumps({"authority": "x", "sha256": "h2"}), json.dumps({"authority": "x", "source_file": "z.md"})):
        with pytest.raises(Exception, match="bad sidecar"):
            manifest.with_authority(files, side(("a.md.source.json", bad))).collect()


def test_binding_digest_sees_every_row_and_no_order(spark):
    data = [("b", "h2", "pending", None), ("a", "h1", "duplicate", "b")]
    digest = lambda x: manifest.binding_digest(spark.createDataFrame(x, "path string, sha256 string, status string, duplicate_of string")).first()[0]
    assert digest(data) == digest(data[::-1]) and len({digest(data), digest(data[:1]), digest([data[0], ("a", "h1", "pending", "b")])}) == 3


def test_unreferenced_and_ledger_files(spark):
    own = spark.createDataFrame([("x/a.md", "pending"), ("y/a.md", "pending"), ("b.md", "pending"), ("c.md", "duplicate")], "path string, status string")
    assert rows(manifest.unreferenced_sources(own, spark.createDataFrame([("b.md",)], "source string")), "path") == [("x/a.md",), ("y/a.md",)]
    ledger = spark.createDataFrame([("a.md",), ("x/a.md",), ("b.md",), ("z.md",), ("d.md",)], "file string")
    got = dict(rows(manifest.ledger_files(ledger, own)))
    assert got == {"a.md": None, "x/a.md": "x/a.md", "b.md": "b.md", "z.md": None, "d.md": None}


def test_focus(spark):
    asked = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "id string")
    said = spark.createDataFrame([("f1", "satisfied"), ("f2", "not_found"), ("f9", "satisfied")], "id string, outcome string")
    assert rows(validators.focus_outcomes(asked, said)) == [("f2", "FOCUS_UNMET"), ("f3", "FOCUS_UNANSWERED"), ("f9", "FOCUS_UNASKED")]
    codes = spark.createDataFrame([("E1",), ("e2",), ("E3",)], "code string")
    assert rows(validators.floor_shortfall(codes, spark.createDataFrame([("e1",), ("E2",)], "code string"))) == [("E3",)]
    files = spark.createDataFrame([("a",), ("b",)], "source string")
    assert rows(validators.unsearched(files, files.where("source = 'a'"))) == [("b",)]


def test_domain_rules_and_parameters(spark):
    ops = spark.createDataFrame([("o1",), ("o2",), ("o2",), ("o3",)], "identity string")
    answers = spark.createDataFrame([("o1", "200"), ("o2", "404")], "identity string, status string")
    proof = spark.createDataFrame([("o1",), ("o2",)], "identity string")
    found = set(rows(validators.domain_rules(ops, answers, proof), "code", "location"))
    assert found == {("DUPLICATE_IDENTITY", "o2"), ("RESPONSE_MISSING", "o3"), ("SUCCESS_RESPONSE_MISSING", "o2"), ("EVIDENCE_MISSING", "o3")}
    paths = spark.createDataFrame([("/a/{id}", ["id"]), ("/a/{id}", []), ("/a", ["x"])], "p string, d array<string>")
    assert rows(validators.orphan_parameters(paths, "p", "d"), "undeclared", "unused") == [([], ["x"]), (["id"], [])]


def test_deferrals(spark):
    leaves = spark.createDataFrame([(1, "/a", '"See the documentation"'), (1, "/b", '"TBD"'), (1, "/c", '"not tbd"'), (1, "/missing/0", '"tbd"'), (1, "/d", "5")], "id int, path string, value string")
    assert rows(validators.deferrals(leaves, ["id"]), "path") == [("/a",), ("/b",)]


def test_claims(spark):
    want = spark.createDataFrame([("i", "/a"), ("i", "/b")], "identity string, path string")
    assert rows(claims.uncovered_paths(want, want.where("path = '/a'"))) == [("i", "/b")]
    proof = spark.createDataFrame([("t1", "f2"), ("t1", "f1"), ("t1", "f1")], "target string, fragment_id string")
    assert rows(claims.evidence_by_target(spark.createDataFrame([("t1",), ("t1.x",)], "target string"), proof)) == [("t1", ["f1", "f2"]), ("t1.x", None)]
    kinds = spark.createDataFrame([("operation", "supported"), ("schema", "conflicting"), ("schema", "missing"), ("error", "unverified")], "kind string, status string")
    assert rows(claims.contract_collections(kinds), "status", "collection") == [("conflicting", "conflicts"), ("missing", "gaps"), ("supported", "operation"), ("unverified", "gaps")]
    items = spark.createDataFrame([("a", "s"), ("b", None)], "id string, source string")
    assert rows(related.classify_items(items, F.lit(2)), "id", "status") == [("a", "supported"), ("b", "unverified")]
    assert rows(related.classify_items(items, F.lit(1)), "id", "status") == [("a", "supported"), ("b", "supported")]


def test_artifacts(spark, tmp_path):
    (tmp_path / "w.json").write_text('[{"id": "w1", "claim_identity": "c", "reason": "r", "approved_by": "x", "expires_at": "2030-01-01T00:00:00Z", "scope": ["a"]}]')
    assert rows(artifacts.load(spark, str(tmp_path / "w.json"), "waivers"), "id", "scope", "_file") == [("w1", ["a"], "w.json")]
    (tmp_path / "bad.json").write_text('[{"id": {"x": 1}, "scope": 5]')
    with pytest.raises(Exception):
        artifacts.load(spark, str(tmp_path / "bad.json"), "waivers").collect()
    df = spark.createDataFrame([("B", 2), ("A", 1)], "code string, n int")
    artifacts.write_report(df, f"{tmp_path}/report")
    assert rows(spark.read.json(f"{tmp_path}/report/json"), "code", "n") == [("A", 1), ("B", 2)]
    assert rows(spark.read.text(f"{tmp_path}/report/markdown")) == [("| A | 1 |",), ("| B | 2 |",)]
    with pytest.raises(Exception):
        artifacts.write_once(df, f"{tmp_path}/report/json", "json")


def test_published_versions(spark, tmp_path):
    root, df = f"{tmp_path}/out", spark.range(3)
    assert artifacts.current(spark, root) is None
    artifacts.publish(df, root, "v1")
    assert artifacts.current(spark, root) == "v1"
    with pytest.raises(RuntimeError, match="not"):
        artifacts.publish(df, root, "v2", expected="v0")
    artifacts.publish(df, root, "v2", expected="v1")
    assert artifacts.current(spark, root) == "v2"
    with pytest.raises(Exception):  # another writer that also started from v1
        artifacts.publish(df, root, "v3", expected="v1")


def test_imports_and_fragments(spark):
    own = spark.createDataFrame([("a.md", "h1")], "relative_path string, sha256 string")
    ledger = lambda *x: spark.createDataFrame(list(x), "file string, sha256 string")
    assert rows(artifacts.verified_imports(ledger(("a.md", "h1")), own), "file", "verified") == [("a.md", True)]
    for bad in (("a.md", "h2"), ("b.md", "h1")):
        with pytest.raises(Exception, match="does not match"):
            artifacts.verified_imports(ledger(bad), own).collect()
    docs = spark.createDataFrame([("s", "a\r\nb\nc")], "source string, text string")
    asked = spark.createDataFrame([("s", 1, 2), ("s", 3, 3), ("s", 3, 4), ("s", 0, 1), ("t", 1, 1)], "source string, start_line int, end_line int")
    got = {(r.source, r.start_line, r.end_line): (r.excerpt, r.precision) for r in artifacts.line_fragments(docs, asked).collect()}
    assert got == {("s", 1, 2): ("a\nb", "exact"), ("s", 3, 3): ("c", "exact"), ("s", 3, 4): (None, "unresolved"), ("s", 0, 1): (None, "unresolved"), ("t", 1, 1): (None, "unresolved")}


def test_tables_of_pages(spark):
    pages = [
        "<table><tr><th>a<th>b<tr><td>1<td>2<tr><td>3<td>4</table>", "<table><tfoot><tr><td>f</td></tr></tfoot><tr><td>x</td></tr><thead><tr><td>h</td></tr></thead></table>", "<table><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr></table>",
        "<table><tr><td>out <table><tr><td>in</td></tr></table></td></tr></table>", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: [(c["row"], c.col, c.text) for c in r.cells if c["table"] == 0] for r in df.select("id", html.table_cells("html").alias("cells")).collect()}
    assert got[0] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2"), (2, 0, "3"), (2, 1, "4")]
    assert got[1] == [(0, 0, "h"), (1, 0, "x"), (2, 0, "f")]
    assert got[2] == [(0, 0, "r"), (0, 1, "1"), (1, 0, "r"), (1, 1, "2")] or got[2] == [(0, 0, "r"), (0, 1, "1"), (1, 0, ""), (1, 1, "2")]
    assert [x[:2] for x in got[3]] == [(0, 0)] and got[4] == got[5] == []


def test_titles(spark):
    df = spark.createDataFrame([("x\n# One two \n# Three",), ("## no",), ("",)], "m string")
    assert [r[0] for r in df.select(html.document_title("m")).collect()] == ["One two", None, None]


def test_landed_specifications(spark):
    spec = lambda **x: json.dumps({"openapi": "3.1.0", "info": {"version": "1.2"}} | x)
    bodies = [(200, spec()), (200, json.dumps({"swagger": "2.0"})), (200, spec(openapi="4.0")), (404, spec()), (200, "<html>"), (200, None), (200, spec(x="y" * 99)), (200, spec(info={"version": 3}))]
    df = spark.createDataFrame([(f"u{i}", *b) for i, b in enumerate(bodies)], "url string, status int, body string")
    got = {r.url: (r.status, r.version) for r in artifacts.landed_specs(df, max_bytes=100).collect()}
    assert [got[f"u{i}"] for i in range(8)] == [("accepted", "1.2"), ("accepted", None), ("not_a_specification", None), ("not_fetched", None), ("not_a_specification", None), ("not_fetched", None), ("too_large", None), ("accepted", None)]


def test_supplementary_notes(spark):
    note = lambda *x: spark.createDataFrame([x], "file string, content string, received_from string, received_at string, excerpted_by string, subject string")
    r = artifacts.supplementary_notes(note("n.md", "text", "Ann", "2024-05-01T10:00:00+08:00", "Bo", None)).first()
    side = json.loads(r.provenance)
    assert (r.path, r.provenance_path, r.sha256, r.authority) == ("n.md", "n.md.source.json", hashlib.sha256(b"text").hexdigest(), "supplementary")
    assert side == {"schema_version": 1, "authority": "supplementary", "received_from": "Ann", "received_at": "2024-05-01T02:00:00Z", "excerpted_by": "Bo", "imported_sha256": r.sha256, "source_file": "n.md"}
    files = spark.createDataFrame([("n.md", r.sha256)], "path string, sha256 string")
    assert rows(manifest.with_authority(files, spark.createDataFrame([(r.provenance_path, r.provenance)], "path string, content string")), "authority") == [("supplementary",)]
    good = ["n.md", "t", "Ann", "2024-05-01T10:00:00Z", "Bo", None]
    for k, bad in ((0, "a/n.md"), (0, "n.txt"), (2, " "), (3, "2024-05-01T10:00:00"), (3, "soon+08:00"), (4, None)):
        with pytest.raises(Exception, match="n\\."):
            artifacts.supplementary_notes(note(*[bad if i == k else x for i, x in enumerate(good)])).collect()
    with pytest.raises(Exception, match="twice"):
        artifacts.supplementary_notes(note(*good).union(note(*good))).collect()


def test_prepared_documents(spark):
    files = [("a.md", b"ok \xff"), ("b.bin", b"\xff\x00"), ("c.pdf", b"%PDF"), ("d/e.TXT", "é".encode())]
    df = lambda x: spark.createDataFrame(x, "path string, content binary")
    got = {r.path: (r.output, r.kind, bytes(r.content)) for r in artifacts.prepared_documents(df(files)).collect()}
    assert got == {"a.md": ("a.md", "text", "ok \ufffd".encode()), "b.bin": ("b.bin", "passthrough", b"\xff\x00"), "c.pdf": ("c.pdf.md", "unconverted", b"%PDF"), "d/e.TXT": ("d/e.TXT", "text", "é".encode())}
    with pytest.raises(Exception, match="several files"):
        artifacts.prepared_documents(df([*files, ("c.pdf.md", b"x")])).collect()
