"""Queries over contracts of each customer: orders are the claims, their lines the relationships that prove them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import grounding
from attestor.plans.registry import query

_OPERATION = '{"method":"GET","parameters":[{"location":"query","name":"p1"},{"location":"a/b","name":"p2"},{"name":"nowhere"},"odd"],"responses":[{"status_code":"200"}]}'
_SCHEMA = '{"fields":[{"name":"f1"},{"name":"f2"},{"name":"f2"}]}'


def _claims(t) -> tuple[DataFrame, DataFrame]:
    even, key = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")
    status = F.when(F.col("o_orderkey") % 11 == 0, "conflicting").when(F.col("o_orderkey") % 7 == 0, "missing").when(F.col("o_orderkey") % 5 == 0, "unverified").otherwise("supported")
    value = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("["), key, F.lit(',"x"]'))).when(even, _OPERATION).otherwise(_SCHEMA)
    claims = t.orders.select(F.col("o_custkey").alias("contract"), key.alias("identity"), F.when(even, "operation").otherwise("schema").alias("claim_kind"), status.alias("status"), value.alias("value"), F.array(F.lit("f1"), key).alias("evidence_refs"))
    n = F.col("l_linenumber")
    path = F.when(F.col("l_orderkey") % 2 == 1, F.concat(F.lit("/fields/f"), (n % 3).cast("string"), F.lit("/type"))).when(n % 4 == 0, "/parameters/query/p1/name").when(n % 4 == 1, "/parameters/a~1b/p2/required").when(n % 4 == 2, "/responses/200/schema_ref").otherwise("/parameters/query/p1")
    owner = t.orders.select("o_orderkey", F.col("o_custkey").alias("contract"))
    lines = t.lineitem.join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
    told = lines.select("contract", F.col("l_orderkey").cast("string").alias("claim_identity"), n.alias("ord"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit("f"), "l_suppkey").alias("fragment_id"), path.alias("claim_path"), F.lit("explicit_support").alias("relationship"))
    return claims, told


_SQL = """c AS (SELECT o_custkey AS contract, o_orderkey AS k, o_orderkey::VARCHAR AS identity, CASE WHEN o_orderkey % 11 = 0 THEN 'conflicting' WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'unverified' ELSE 'supported' END AS status FROM orders),
r AS (SELECT o_custkey AS contract, o_orderkey AS k, l_linenumber AS ord, l_partkey || '-' || l_suppkey AS id, 'f' || l_suppkey AS fragment, CASE WHEN l_orderkey % 2 = 1 THEN '/fields/f' || (l_linenumber % 3) || '/' WHEN l_linenumber % 4 = 0 THEN '/parameters/query/p1/' WHEN l_linenumber % 4 = 1 THEN '/parameters/a~1b/p2/' WHEN l_linenumber % 4 = 2 THEN '/responses/200/' END AS prefix FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {_SQL},
k AS (SELECT 0 AS odd, 'parameters' AS child, 0 AS pos, '/parameters/query/p1/' AS prefix UNION ALL VALUES (0, 'parameters', 1, '/parameters/a~1b/p2/'), (0, 'parameters', 2, NULL), (0, 'parameters', 3, NULL), (0, 'responses', 0, '/responses/200/'), (1, 'fields', 0, '/fields/f1/'), (1, 'fields', 1, '/fields/f2/'), (1, 'fields', 2, '/fields/f2/'))
SELECT c.contract, identity, child, pos, coalesce(string_agg(fragment, ',' ORDER BY ord, id), '') AS fragments FROM c JOIN k ON c.k % 2 = k.odd LEFT JOIN r ON r.k = c.k AND r.prefix = k.prefix WHERE status = 'supported' GROUP BY ALL""")
def grounded_children(t):
    """Parameters, responses and fields of every supported claim with the fragments that prove each."""
    claims, told = _claims(t)
    items = grounding.grounded_items(grounding.claim_evidence(claims, told))
    found = grounding.child_evidence(items, told)
    return found.select("contract", "identity", "child", "pos", F.array_join(F.transform("evidence", lambda e: e["fragment_id"]), ",").alias("fragments"))


@query(f"""WITH {_SQL},
e AS (SELECT k, string_agg(fragment, ',' ORDER BY ord, id) AS proven, list(fragment) AS have FROM r GROUP BY k),
a AS (SELECT c.*, concat_ws(',', proven, CASE WHEN list_contains(coalesce(have, []), 'f1') THEN NULL ELSE 'f1' END, identity) AS fragments FROM c LEFT JOIN e USING (k))
SELECT contract, identity, CASE status WHEN 'missing' THEN 'gaps' WHEN 'conflicting' THEN 'conflicts' ELSE CASE WHEN k % 2 = 0 THEN 'operations' ELSE 'schemas' END END AS collection,
  CASE status WHEN 'missing' THEN 'source fact missing' WHEN 'conflicting' THEN identity || '|"x"' ELSE '' END AS told, fragments FROM a WHERE status <> 'unverified'""")
def grounded_contract(t):
    """Where every claim went: its collection, the gaps or the conflicts, with all its evidence."""
    evident = grounding.claim_evidence(*_claims(t))
    ids = F.array_join(F.transform("evidence", lambda e: e["fragment_id"]), ",").alias("fragments")
    items = grounding.grounded_items(evident).select("contract", "identity", "collection", F.lit("").alias("told"), ids)
    missing = grounding.gaps(evident).select("contract", "identity", F.lit("gaps").alias("collection"), F.col("reason").alias("told"), ids)
    return items.unionAll(missing).unionAll(grounding.conflicts(evident).select("contract", "identity", F.lit("conflicts"), F.array_join("values", "|"), ids))
