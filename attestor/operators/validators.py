"""Validators as findings tables (V08-V17, J-EQ6, J-SEMI1, J-SEMI2, U01)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = ["code", "severity", "location", "evidence"]


def finding(rows: DataFrame, code: str, severity: str, location, evidence) -> DataFrame:
    """Rows as findings of one shape."""
    col = lambda x: x if isinstance(x, Column) else F.col(x)
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), col(location).cast("string").alias("location"), col(evidence).cast("string").alias("evidence"))


def union(parts: list[DataFrame]) -> DataFrame:
    """All validators' findings."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """References that resolve to nothing (J-EQ6)."""
    return refs.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias(ref)).distinct(), ref, "left_anti")


def completeness(operations: DataFrame) -> DataFrame:
    """Operations (location, method, summary, n_responses, n_examples, server, status) without what they need."""
    checks = [
        ("method is null or trim(method) = ''", "REQUIRED_INFO_MISSING", "error", "method"), ("n_responses = 0", "REQUIRED_INFO_MISSING", "error", "responses"),
        ("summary is null or trim(summary) = ''", "REQUIRED_INFO_MISSING", "warning", "summary"), ("n_examples = 0", "REQUIRED_INFO_MISSING", "warning", "examples"),
        ("server is null", "REQUIRED_INFO_MISSING", "warning", "server"), ("status = 'unverified'", "SOURCE_UNVERIFIED", "warning", "status"), ("status = 'conflicting'", "SOURCE_CONFLICT", "error", "status"),
    ]
    each = F.array(*[F.when(F.expr(cond), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(what).alias("evidence"))) for cond, code, sev, what in checks])
    return operations.select("location", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.code", "f.severity", "location", "f.evidence")


def consistency(openapi: DataFrame, markdown: DataFrame, key: str) -> DataFrame:
    """What only one of two outputs has."""
    from attestor.operators.compare import symmetric_difference

    return finding(symmetric_difference(openapi, markdown, [key]), "OUTPUT_MISMATCH", "error", key, "side")


def orphan_parameters(operations: DataFrame, path: str, declared: str) -> DataFrame:
    """Path tokens that no parameter declares, and path parameters without a token."""
    from attestor.functions.text import path_tokens

    tokens = path_tokens(F.col(path))
    return operations.withColumns({"undeclared": F.array_except(tokens, F.col(declared)), "unused": F.array_except(F.col(declared), tokens)}).where("size(undeclared) > 0 or size(unused) > 0")


def speculation(targets: DataFrame, provenance: DataFrame) -> DataFrame:
    """Asserted targets (target, parent) without support (V10): none cited, a conflict, or nothing that supports; a property asks its parent."""
    by = provenance.groupBy("target").agg(F.bool_or(F.col("status") == "supported").alias("ok"), F.bool_or(F.col("status") == "conflicting").alias("clash"))
    own = targets.join(by, "target", "left")
    up = by.select(F.col("target").alias("parent"), F.col("ok").alias("p_ok"), F.col("clash").alias("p_clash"))
    met = own.join(up, "parent", "left").withColumns({"ok": F.coalesce("ok", "p_ok"), "clash": F.coalesce("clash", "p_clash")})
    code = F.when(F.col("ok").isNull(), "UNSUPPORTED_ASSERTION").when(F.col("clash"), "SOURCE_CONFLICT").when(~F.col("ok"), "SOURCE_UNVERIFIED")
    return met.withColumn("code", code).where("code is not null").select("target", "code")


def missing_names(facts: DataFrame, extracted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Fact names of identities that were extracted, which the extraction lacks by whole or leaf name (J-SEMI1)."""
    judged = facts.join(extracted.select(*keys).distinct(), keys, "left_semi")
    leaf = F.lower(F.regexp_extract(name, r"([^.\[\]]*)(?:\[\])?$", 1))
    have = extracted.select(*keys, F.explode(F.array_distinct(F.array(F.lower(name), leaf))).alias("__name")).distinct()
    marked = judged.withColumn("__name", F.lower(name))
    return marked.join(have, [*keys, "__name"], "left_anti").drop("__name")


def focus_outcomes(directives: DataFrame, responses: DataFrame) -> DataFrame:
    """Directives without response and responses without directive (J-SEMI2), and directives that were not met."""
    met = directives.select("id", F.lit(1).alias("asked")).join(responses.select("id", "outcome"), "id", "full_outer")
    code = F.when(F.col("outcome").isNull(), "FOCUS_UNANSWERED").when(F.col("asked").isNull(), "FOCUS_UNASKED").when(F.col("outcome") != "satisfied", "FOCUS_UNMET")
    return met.withColumn("code", code).where("code is not null").select("id", "code")


def floor_shortfall(floor: DataFrame, anchors: DataFrame, code: str = "code") -> DataFrame:
    """Documented error codes that no anchor names, whatever their case."""
    return floor.select(code).distinct().withColumn("__c", F.lower(code)).join(anchors.select(F.lower(code).alias("__c")), "__c", "left_anti").drop("__c")


def unsearched(readable: DataFrame, searched: DataFrame) -> DataFrame:
    """Readable sources that a not-found response does not list (J-SEMI2)."""
    return readable.join(searched, "source", "left_anti")


def supplementary_only(citations: DataFrame, key: str) -> DataFrame:
    """Locations whose citations are all supplementary."""
    return citations.groupBy(key).agg(F.every(F.col("authority") == "supplementary").alias("only"), F.count("*").alias("n")).where("only").select(key, "n")


def unresolved_scopes(citations: DataFrame, scope: str, one_document: bool = False) -> DataFrame:
    """Files with citations of which none resolves; nothing fails where a single document is normative."""
    if one_document:
        return citations.select(scope).limit(0)
    return citations.groupBy(scope).agg(F.bool_or(F.col("source").isNotNull()).alias("any"), F.count("*").alias("n")).where("not any").select(scope, "n")


def bad_paths(entries: DataFrame, path: str, summary: str) -> DataFrame:
    """Paths that do not start with a slash, and entries without path or summary."""
    code = F.when(F.col(path).isNotNull() & ~F.col(path).startswith("/"), "PATH_NOT_ABSOLUTE").when(F.col(path).isNull() & (F.coalesce(F.trim(summary), F.lit("")) == ""), "WEBHOOK_UNNAMED")
    return entries.withColumn("code", code).where("code is not null")


def evidence_mismatches(references: DataFrame, fragments: DataFrame) -> DataFrame:
    """Declared references whose fragment is not there or has another digest."""
    met = references.join(fragments.select("fragment_id", F.col("digest").alias("__digest")), "fragment_id", "left")
    return met.where("__digest is null or __digest != digest").select(*references.columns, F.when(F.col("__digest").isNull(), "missing").otherwise("digest").alias("reason"))


def fact_coverage(sources: DataFrame, facts: DataFrame, identities: DataFrame) -> DataFrame:
    """Facts and matched identities of every readable source; unscanned where none matched or a fence stays open."""
    per = facts.join(identities.select("identity", F.lit(True).alias("__known")).distinct(), "identity", "left").groupBy("source").agg(F.count("*").alias("n_facts"), F.count_if("__known").alias("n_matched"))
    out = sources.join(per, "source", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_facts", "n_matched")})
    return out.withColumn("unscanned", (F.col("n_matched") == 0) | F.col("unclosed_fence"))


def domain_rules(operations: DataFrame, responses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rules of a contract as anti-joins and filters (V17): identities, responses, success, evidence."""
    twice = operations.groupBy("identity").agg(F.count("*").alias("n")).where("n > 1")
    none = operations.join(responses.select("identity").distinct(), "identity", "left_anti")
    hollow = operations.join(responses.where("status rlike '^2'").select("identity").distinct(), "identity", "left_anti").join(responses.select("identity").distinct(), "identity", "left_semi")
    bare = operations.join(evidence.select("identity").distinct(), "identity", "left_anti")
    return union([finding(twice, "DUPLICATE_IDENTITY", "error", "identity", "n"), finding(none, "RESPONSE_MISSING", "error", "identity", F.lit("")), finding(hollow, "SUCCESS_RESPONSE_MISSING", "warning", "identity", F.lit("")), finding(bare, "EVIDENCE_MISSING", "warning", "identity", F.lit(""))])


def applicable_errors(errors: DataFrame, operations: DataFrame) -> DataFrame:
    """Operations with the codes that name them, whatever their case (J-EQ13)."""
    named = errors.select("code", F.explode("applicable_to").alias("__op")).withColumn("__op", F.lower(F.trim("__op")))
    return operations.withColumn("__op", F.lower(F.concat_ws(" ", "method", "path"))).join(named, "__op").drop("__op")


DEFERRALS = ["see the documentation", "refer to the source", "not extracted", "to be extracted"]
PLACEHOLDERS = ["tbd", "todo", "n/a", "..."]


def deferrals(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """Leaves outside ``missing`` that put the work off: a phrase anywhere, a placeholder alone."""
    text = F.lower(F.regexp_replace("value", '^"|"$', ""))
    bad = F.trim(text).isin(PLACEHOLDERS)
    for phrase in DEFERRALS:
        bad = bad | text.contains(phrase)
    return leaves.where(~F.col("path").rlike("(^|/)missing(/|$)") & bad).select(*keep, "path", "value")
