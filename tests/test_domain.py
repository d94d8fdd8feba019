"""Every rule of a contract, with a case that breaks it and one that does not."""

from __future__ import annotations

from attestor.operators import domain


def found(df):
    return sorted((r.code, r.location, r.message) for r in df.collect())


def test_operations_and_interactions(spark):
    rows = [(1, 0, "o0", "get", "/a", 1, 1), (1, 1, "o1", " GET", "/a", 1, 1), (2, 2, "o2", "GET", "/a", 1, 1), (1, 3, "o3", "FETCH", "/a", 0, 1), (1, 4, "o4", "PUT", "a", 1, 0), (1, 5, "o5", None, None, 1, 1)]
    got = found(domain.operation_findings(spark.createDataFrame(rows, "run int, ord int, location string, method string, path string, n_responses int, n_evidence int")))
    assert got == sorted([("OPERATION_IDENTITY_DUPLICATE", "o1", "operation:GET:/a"), ("OPERATION_IDENTITY_INVALID", "o3", "o3"), ("RESPONSE_REQUIRED", "o3", "o3"), ("OPERATION_IDENTITY_INVALID", "o4", "o4"), ("OPERATION_EVIDENCE_REQUIRED", "o4", "o4"), ("OPERATION_IDENTITY_INVALID", "o5", "o5")])
    rows = [(1, "i0", "a", "http", "request_reply", "GET", "/a", 0, 1), (1, "i1", "b", "http", "event", "GET", "/a", 0, 1), (1, "i2", "c", "http", "request_reply", "GET", "x", 1, 0), (1, "i3", "d", "graphql", "request_reply", None, None, 0, 1)]
    got = found(domain.interaction_findings(spark.createDataFrame(rows, "run int, location string, name string, transport string, mode string, method string, path string, n_responses int, n_evidence int")))
    assert got == [("INTERACTION_EVIDENCE_REQUIRED", "i2", "c"), ("INTERACTION_IDENTITY_INVALID", "i2", "c"), ("INTERACTION_RESPONSE_REQUIRED", "i0", "a")]


def test_references(spark):
    refs = [(1, "o0", k, r) for k in domain.UNRESOLVED for r in ("yes", "no")] + [(1, "o0", "schema", "no"), (1, "o1", "schema", None), (2, "o2", "schema", "yes")]
    names = [(1, k, "yes") for k in domain.UNRESOLVED]
    got = found(domain.reference_findings(spark.createDataFrame(refs, "run int, location string, kind string, ref string"), spark.createDataFrame(names, "run int, kind string, name string")))
    assert got == sorted([(code, "o0", "no") for code in domain.UNRESOLVED.values()] + [("SCHEMA_REFERENCE_UNRESOLVED", "o2", "yes")])


def test_parts(spark):
    fields = spark.createDataFrame([(1, "f0", "a", True, " "), (1, "f1", "b", True, None), (1, "f2", "c", False, ""), (1, "f3", "d", True, "if x")], "run int, location string, name string, required boolean, condition string")
    hooks = spark.createDataFrame([(1, "w0", "a", "hmac", None), (1, "w1", "b", "hmac", "200"), (1, "w2", "c", "", "200")], "run int, location string, name string, verification string, expected_response string")
    mechanics = spark.createDataFrame([(1, "m0", "a", "crypto", 0), (1, "m1", "b", "crypto", 1), (1, "m2", "c", "retry", 0)], "run int, location string, name string, kind string, n_steps int")
    assert found(domain.part_findings(fields, hooks, mechanics)) == [("CALLBACK_VERIFICATION_INCOMPLETE", "w0", "a"), ("CALLBACK_VERIFICATION_INCOMPLETE", "w2", "c"), ("CONDITIONAL_REQUIREDNESS_INCOMPLETE", "f0", "a"), ("CRYPTOGRAPHIC_CHAIN_INCOMPLETE", "m0", "a")]


def test_claims(spark):
    claims = spark.createDataFrame([(1, f"c{i}", f"n{i}", s) for i, s in enumerate(["supported", "waived", "supported", "supported", "unverified", "supported"])], "run int, location string, identity string, status string")
    proof = [(1, "c1", None, "explicit_support", "/a"), (1, "c2", "r", "derived_support", "/a"), (1, "c3", "r", "explicit_support", "/a"), (1, "c3", "r", "derived_support", "/b"), (1, "c4", "r", "contradicts", "/a"), (1, "c5", "r", "explicit_support", None)]
    paths = [(1, f"c{i}", p) for i in (2, 3) for p in ("/a", "/b")]
    got = found(domain.claim_findings(claims, spark.createDataFrame(proof, "run int, location string, relationship_id string, relationship string, claim_path string"), spark.createDataFrame(paths, "run int, location string, path string")))
    assert got == sorted([("CLAIM_EVIDENCE_REQUIRED", "c0", "n0"), ("CLAIM_SEMANTIC_SUPPORT_REQUIRED", "c0", "n0"), ("CLAIM_SEMANTIC_SUPPORT_REQUIRED", "c1", "n1"), ("CLAIM_SUPPORT_COVERAGE_INCOMPLETE", "c2", "n2"), ("CLAIM_EVIDENCE_CONTRADICTS", "c4", "n4")])
