"""Contracts built from reconciled claims: typed collections, gaps, conflicts, and evidence routed to what it proves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.json_text import pointer_escape

#: The collection of each kind of claim.
COLLECTIONS = {
    "environment": "environments", "interaction": "interactions", "operation": "operations", "webhook": "webhooks", "schema": "schemas", "security": "security", "error": "errors",
    "integration_mechanic": "integration_mechanics", "operational_constraint": "operational_constraints", "transport_policy": "transport_policies", "idempotency_rule": "idempotency_rules",
    "amount_direction": "amount_directions", "line_currency_policy": "line_currency_policies",
}
_CLAIM = ["contract", "identity"]
#: Fixed value: why a claim without source is a gap.
NO_SOURCE = "source fact missing"


def claim_evidence(claims: DataFrame, relationships: DataFrame) -> DataFrame:
    """``claims`` with ``evidence``: the relationships of each in order, then the fragments it merely cites and that none of them has.

    claims: contract, identity, evidence_refs (array) and more; relationships: contract, claim_identity, ord, id, fragment_id, claim_path,
    relationship. A claim without either has an empty list; relationships of unknown claims are left out.
    """
    one = F.struct("ord", "id", "fragment_id", "claim_path", "relationship")
    told = relationships.groupBy("contract", F.col("claim_identity").alias("identity")).agg(F.sort_array(F.collect_list(one)).alias("told"))
    proof = lambda fragment, r=None: F.struct(fragment.alias("fragment_id"), *[(F.lit(None).cast("string") if r is None else r[c]).alias(n) for c, n in (("id", "relationship_id"), ("claim_path", "claim_path"), ("relationship", "relationship"))])
    met = claims.join(told, _CLAIM, "left")
    proven = F.coalesce(F.transform("told", lambda r: proof(r["fragment_id"], r)), F.array().cast("array<struct<fragment_id:string,relationship_id:string,claim_path:string,relationship:string>>"))
    have = F.coalesce(F.transform("told", lambda r: r["fragment_id"]), F.array().cast("array<string>"))
    cited = F.filter(F.coalesce("evidence_refs", F.array().cast("array<string>")), lambda f: ~F.array_contains(have, f))
    return met.withColumn("evidence", F.concat(proven, F.transform(cited, lambda f: proof(f)))).drop("told")


def grounded_items(evident: DataFrame) -> DataFrame:
    """(contract, collection, identity, value, evidence) of supported and waived claims whose kind has a collection and whose value is an object."""
    kinds = F.create_map(*[F.lit(x) for pair in COLLECTIONS.items() for x in pair])
    items = evident.where(F.col("status").isin("supported", "waived") & F.col("value").startswith("{")).withColumn("collection", F.try_element_at(kinds, F.col("claim_kind")))
    return items.where("collection is not null").select("contract", "collection", "identity", "value", "evidence")


def gaps(evident: DataFrame) -> DataFrame:
    """(contract, identity, reason, evidence) of claims whose source is missing."""
    return evident.where("status = 'missing'").select("contract", "identity", F.lit(NO_SOURCE).alias("reason"), "evidence")


def conflicts(evident: DataFrame) -> DataFrame:
    """(contract, identity, values, evidence) of conflicting claims: the elements of an array, else the value alone, as JSON."""
    each = F.transform(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), lambda v: F.to_json(v))
    values = F.when(F.col("value").startswith("["), each).otherwise(F.array(F.coalesce("value", F.lit("null"))))
    return evident.where("status = 'conflicting'").select("contract", "identity", values.alias("values"), "evidence")


def _text(node: Column, name: str) -> Column:
    """A member as text, null where it is missing or null."""
    return F.try_variant_get(node, f"$.{name}", "string")


def child_evidence(items: DataFrame, relationships: DataFrame) -> DataFrame:
    """(contract, identity, child, pos, value, evidence): parameters and responses of operations, fields of schemas, each with what proves it.

    A relationship belongs to the child whose path its own goes on from: the child's prefix is built from its name, place
    or status with escapes, the relationship's is cut from its path, and the two meet by equality; nothing is compared with every
    child. Children that repeat a name share their evidence; one without name, or that no path leads to, has
    none (an empty list); what is no object keeps its place and has none.
    """
    node = F.try_parse_json("value")
    wanted = F.array(*[
        F.struct(F.lit(owner).alias("owner"), F.lit(name).alias("child"), F.try_variant_get(node, f"$.{name}", "array<variant>").alias("nodes"))
        for owner, name in (("operations", "parameters"), ("operations", "responses"), ("schemas", "fields"))
    ])
    lists = items.select("contract", "identity", "collection", F.explode(wanted).alias("w")).where("collection = w.owner")
    each = lists.select("contract", "identity", "w.child", F.posexplode("w.nodes").alias("pos", "node"))
    piece = lambda name: pointer_escape(_text(F.col("node"), name))
    prefix = (
        F.when(F.col("child") == "parameters", F.concat(F.lit("/parameters/"), piece("location"), F.lit("/"), piece("name"), F.lit("/")))
        .when(F.col("child") == "responses", F.concat(F.lit("/responses/"), piece("status_code"), F.lit("/")))
        .otherwise(F.concat(F.lit("/fields/"), piece("name"), F.lit("/")))
    )
    each = each.withColumn("prefix", F.when(F.to_json("node").startswith("{"), prefix)).withColumn("value", F.to_json("node")).drop("node")
    parts = F.split("claim_path", "/")
    cut = F.when(F.get(parts, F.lit(1)) == "parameters", 4).otherwise(3)
    own = F.when(F.get(parts, F.lit(1)).isin("parameters", "responses", "fields") & (F.size(parts) > cut), F.concat(F.array_join(F.slice(parts, F.lit(1), cut), "/"), F.lit("/")))
    told = relationships.select("contract", F.col("claim_identity").alias("identity"), own.alias("prefix"), F.struct("ord", "id", "fragment_id", "claim_path", "relationship").alias("r")).where("prefix is not null")
    routed = told.groupBy("contract", "identity", "prefix").agg(F.sort_array(F.collect_list("r")).alias("evidence"))
    met = each.join(routed, ["contract", "identity", "prefix"], "left")
    return met.select("contract", "identity", "child", "pos", "value", F.coalesce("evidence", F.array().cast(routed.schema["evidence"].dataType)).alias("evidence"))
