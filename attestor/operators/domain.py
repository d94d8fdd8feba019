"""The rules of a grounded contract as filters and anti-joins over its parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.identity import operation_identity

#: The finding of a reference of each kind that leads nowhere.
UNRESOLVED = {"schema": "SCHEMA_REFERENCE_UNRESOLVED", "security": "SECURITY_REFERENCE_UNRESOLVED", "server": "SERVER_REFERENCE_UNRESOLVED", "integration": "INTEGRATION_REFERENCE_UNRESOLVED", "error": "ERROR_APPLICABILITY_UNRESOLVED"}
#: Relationships of evidence that support a claim, and statuses that need support.
SUPPORT, SUPPORTED, CRYPTO = ["explicit_support", "derived_support"], ["supported", "waived"], ["crypto", "encryption", "signature"]


def _where(rows: DataFrame, condition: Column, code: str, message: str) -> DataFrame:
    return rows.where(F.coalesce(condition, F.lit(False))).select("run", F.lit(code).alias("code"), "location", F.col(message).cast("string").alias("message"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def operation_findings(operations: DataFrame) -> DataFrame:
    """Findings about operations (run, ord, location, method, path, n_responses, n_evidence): identity, repeats, responses, evidence."""
    own = operations.withColumn("identity", operation_identity(F.col("method"), F.col("path"), strict=False)).withColumn("name", F.coalesce("identity", "location"))
    first = own.where("identity is not null").groupBy("run", "identity").agg(F.min("ord").alias("first"))
    met = own.join(first, ["run", "identity"], "left")
    return _all([
        _where(met, F.col("identity").isNull(), "OPERATION_IDENTITY_INVALID", "location"), _where(met, F.col("ord") > F.col("first"), "OPERATION_IDENTITY_DUPLICATE", "name"),
        _where(met, F.col("n_responses") == 0, "RESPONSE_REQUIRED", "name"), _where(met, F.col("n_evidence") == 0, "OPERATION_EVIDENCE_REQUIRED", "name"),
    ])


def interaction_findings(interactions: DataFrame) -> DataFrame:
    """Findings about interactions (run, location, name, transport, mode, method, path, n_responses, n_evidence)."""
    http = F.col("transport") == "http"
    return _all([
        _where(interactions, http & operation_identity(F.col("method"), F.col("path"), strict=False).isNull(), "INTERACTION_IDENTITY_INVALID", "name"),
        _where(interactions, http & (F.col("mode") == "request_reply") & (F.col("n_responses") == 0), "INTERACTION_RESPONSE_REQUIRED", "name"), _where(interactions, F.col("n_evidence") == 0, "INTERACTION_EVIDENCE_REQUIRED", "name"),
    ])


def reference_findings(refs: DataFrame, names: DataFrame) -> DataFrame:
    """References (run, location, kind, ref) that no name (run, kind, name) of their kind answers, once for each place; servers and integrations alike."""
    codes = F.create_map(*[F.lit(x) for pair in UNRESOLVED.items() for x in pair])
    asked = refs.where("coalesce(ref, '') != ''").select("run", "location", "kind", "ref").distinct()
    lost = asked.join(names.select("run", "kind", F.col("name").alias("ref")).distinct(), ["run", "kind", "ref"], "left_anti")
    return lost.select("run", F.element_at(codes, F.col("kind")).alias("code"), "location", F.col("ref").alias("message"))


def part_findings(fields: DataFrame, webhooks: DataFrame, mechanics: DataFrame) -> DataFrame:
    """Findings about schema fields (run, location, name, required, condition), webhooks (run, location, name, verification, expected_response) and mechanics (run, location, name, kind, n_steps)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return _all([
        _where(fields, F.col("required") & (F.trim("condition") == ""), "CONDITIONAL_REQUIREDNESS_INCOMPLETE", "name"), _where(webhooks, empty("verification") | empty("expected_response"), "CALLBACK_VERIFICATION_INCOMPLETE", "name"),
        _where(mechanics, F.col("kind").isin(CRYPTO) & (F.col("n_steps") == 0), "CRYPTOGRAPHIC_CHAIN_INCOMPLETE", "name"),
    ])


def claim_findings(claims: DataFrame, evidence: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings about claims (run, location, identity, status) from their evidence (run, location, relationship_id, relationship, claim_path) and the paths (run, location, path) that support must cover.

    A supported or waived claim needs evidence, and support that is verified as such, for each of its paths; what contradicts a claim is
    always told. Evidence and paths are counted together, by path and then by claim, and claims meet the
    counts once for all findings.
    """
    semantic = F.col("relationship_id").isNotNull() & F.col("relationship").isin(SUPPORT)
    keys, zero, numbers = ["run", "location"], F.lit(0).cast("long"), ["n", "n_semantic", "n_against"]
    told = evidence.select(*keys, F.col("claim_path").alias("path"), F.lit(1).cast("long").alias("n"), semantic.cast("long").alias("n_semantic"), (F.col("relationship") == "contradicts").cast("long").alias("n_against"), F.lit(False).alias("is_asked"))
    asked = paths.select(*keys, "path", zero, zero, zero, F.lit(True))
    sums = [F.coalesce(F.sum(c), zero).alias(c) for c in numbers]
    by_path = told.unionAll(asked).groupBy(*keys, "path").agg(*sums, F.bool_or("is_asked").alias("is_asked"))
    counts = by_path.groupBy(*keys).agg(*sums, F.count_if(F.col("is_asked") & (F.col("path").isNull() | (F.col("n_semantic") == 0))).alias("n_gaps"))
    met = claims.select(*keys, "identity", "status").join(counts, keys, "left").fillna(0, [*numbers, "n_gaps"])
    needs = F.col("status").isin(SUPPORTED)
    codes = F.array(
        F.when(needs & (F.col("n") == 0), "CLAIM_EVIDENCE_REQUIRED"), F.when(needs & (F.col("n_semantic") == 0), "CLAIM_SEMANTIC_SUPPORT_REQUIRED"),
        F.when(needs & (F.col("n_semantic") > 0) & (F.col("n_gaps") > 0), "CLAIM_SUPPORT_COVERAGE_INCOMPLETE"), F.when(F.col("n_against") > 0, "CLAIM_EVIDENCE_CONTRADICTS"),
    )
    return met.select("run", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"), "location", F.col("identity").cast("string").alias("message"))
