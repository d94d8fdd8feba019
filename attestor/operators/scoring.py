"""Scores, root causes and loop verdicts (G05-G08, V08-V15 roll-up, V18, V23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category of each issue code, weights, penalties and thresholds.
CATEGORY = {"OPENAPI_INVALID": "openapi_validity", "REQUIRED_INFO_MISSING": "completeness", "OUTPUT_MISMATCH": "consistency", "SOURCE_UNVERIFIED": "source_grounding", "SOURCE_CONFLICT": "source_grounding", "SOURCE_FACTS_UNSCANNED": "source_grounding", "UNSUPPORTED_ASSERTION": "source_grounding", "SUPPLEMENTARY_SUPPORT": "source_grounding", "REVIEW_HTML_MISSING": "reviewability", "VALIDATION_MARKDOWN_MISSING": "reviewability", "SOURCE_UNSUPPORTED": "reviewability", "SOURCE_UNREADABLE": "reviewability"}
WEIGHTS = {"openapi_validity": 20, "completeness": 30, "consistency": 20, "source_grounding": 20, "reviewability": 10}
WARNING_PENALTY, ERROR_PENALTY = 12, 40
PENALTIES = {"OPENAPI_INVALID": 100, "UNSUPPORTED_ASSERTION": 50, "SOURCE_CONFLICT": 50}
REVIEWABILITY = {"REVIEW_HTML_MISSING": 20, "VALIDATION_MARKDOWN_MISSING": 10, "SOURCE_UNSUPPORTED": 10, "SOURCE_UNREADABLE": 15}
UNSCORED = ["FOCUS_UNMET", "FOCUS_INCOMPLETE"]
REVIEW_BLOCKING = ["OPENAPI_INVALID", "OUTPUT_MISMATCH", "SOURCE_CONFLICT", "UNSUPPORTED_ASSERTION"]
REDUCIBLE = ["OPENAPI_INVALID", "OUTPUT_MISMATCH", "REQUIRED_INFO_MISSING", "SOURCE_UNVERIFIED"]
PROFILES = {"ci": (85, 70), "review": (70, 60)}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def penalty(code: Column, severity: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(REVIEWABILITY), code), F.when(severity == "warning", WARNING_PENALTY).otherwise(F.coalesce(F.try_element_at(_map(PENALTIES), code), F.lit(ERROR_PENALTY))))


def category_scores(issues: DataFrame, keys: list[str]) -> DataFrame:
    """A score of each category for each key: 100 less its penalties, 0 at least."""
    scored = issues.where(~F.col("code").isin(UNSCORED)).withColumn("category", F.try_element_at(_map(CATEGORY), F.col("code")))
    scored = scored.withColumn("penalty", penalty(F.col("code"), F.col("severity")))
    sums = [F.greatest(F.lit(0), 100 - F.coalesce(F.sum(F.when(F.col("category") == c, F.col("penalty"))), F.lit(0))).cast("int").alias(c) for c in WEIGHTS]
    return scored.groupBy(*keys).agg(*sums)


def weighted_total(scores: DataFrame) -> Column:
    """The weighted mean, halves to the even neighbour."""
    del scores
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0))
    return F.bround(total / F.lit(100.0), 0).cast("int")


def evaluate(issues: DataFrame, keys: list[str], profile: str = "ci", min_score: int | None = None) -> DataFrame:
    """Category scores, total and status of each key."""
    minimum, gate = PROFILES[profile]
    minimum = minimum if min_score is None else min_score
    error = F.col("severity") == "error"
    blocking = error if profile == "ci" else error & F.col("code").isin(REVIEW_BLOCKING)
    scored = issues.where(~F.col("code").isin(UNSCORED))
    flags = scored.groupBy(*keys).agg(F.coalesce(F.bool_or(blocking), F.lit(False)).alias("blocking"), F.count("*").alias("n_findings"))
    scores = category_scores(issues, keys)
    out = scores.withColumn("total", weighted_total(scores)).join(flags, keys)
    low = F.least(*WEIGHTS) < gate
    status = F.when(F.col("blocking"), "fail").when(F.col("total") < minimum, "fail").when(low | (F.col("n_findings") > 0), "needs_attention").otherwise("pass")
    return out.withColumn("status", status)


def loop_verdict(previous: Column, current: Column, target: Column, round_: Column, max_rounds: Column, n_reducible: Column) -> Column:
    return F.when(current >= target, "converged").when(round_ >= max_rounds, "exhausted").when(n_reducible == 0, "plateau").when(previous.isNotNull() & (current <= previous), "plateau").otherwise("continue")


def root_causes(issues: DataFrame) -> DataFrame:
    """Groups of two or more issues of one code, severity and file, with their locations in order."""
    g = issues.where("target_file is not null").groupBy("code", "severity", "target_file")
    out = g.agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "location"))), lambda x: x.location), ",").alias("locations"))
    return out.where("n > 1")


def corrections(findings: DataFrame) -> DataFrame:
    """Error codes to correct for each root cause, claim or location."""
    key = F.coalesce("root_cause", "claim", "location")
    return findings.where("severity = 'error'").groupBy(key.alias("target")).agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


def repeated_identities(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Identities whose number differs between what is listed and what is there."""
    a = expected.groupBy(key).agg(F.count("*").alias("n_expected"))
    b = actual.groupBy(key).agg(F.count("*").alias("n_actual"))
    met = a.join(b, key, "full_outer").select(key, F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_actual", F.lit(0)).alias("n_actual"))
    return met.where("n_expected != n_actual or n_actual > 1")


def phase_status(findings: DataFrame, keys: list[str]) -> DataFrame:
    """blocked with an error, needs_attention with a warning, else ready, at each level of ``keys``."""
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return findings.rollup(*keys).agg(worst.alias("__w"), F.count("*").alias("n")).select(*keys, F.when(F.col("__w") == 2, "blocked").when(F.col("__w") == 1, "needs_attention").otherwise("ready").alias("status"), "n")


def policy_decision(findings: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """reject, review or accept of each key after severity overrides (code, new_severity) and waivers."""
    met = findings.join(overrides, "code", "left").withColumn("severity", F.coalesce("new_severity", "severity"))
    live = F.col("waiver_id").isNull()
    decision = F.when(F.coalesce(F.bool_or(live & (F.col("severity") == "error")), F.lit(False)), "reject").when(F.coalesce(F.bool_or(live & (F.col("severity") == "warning")), F.lit(False)), "review").otherwise("accept")
    return met.groupBy(*keys).agg(decision.alias("decision"), F.count("*").alias("n"))
