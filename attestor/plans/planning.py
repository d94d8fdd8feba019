"""Queries over the order tables, which stand in for extracted endpoints, details, schemas and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions.json_text import json_leaves
from attestor.operators import answers, domain, openapi, planning
from attestor.plans.registry import query


@query("""WITH e AS (SELECT o_custkey AS run, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'get' ELSE 'post' END AS m, '/' || o_orderpriority AS path FROM orders), k AS (SELECT run, m, path, min(ord) AS endpoint FROM e WHERE ord % 3 <> 0 GROUP BY ALL), f AS (SELECT run, m, path, min(ord) AS first FROM e GROUP BY ALL)
SELECT run, ord AS detail, endpoint, CASE WHEN endpoint IS NULL THEN first END AS added FROM e JOIN f USING (run, m, path) LEFT JOIN k USING (run, m, path)""")
def detail_endpoint_match(t):
    own = t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("ord"), "o_orderstatus", F.concat(F.lit("/"), "o_orderpriority").alias("path"))
    known = own.where("ord % 3 != 0").withColumn("method", F.when(F.col("o_orderstatus") == "F", " get").otherwise("POST"))
    return planning.match_details(known, own.withColumn("method", F.when(F.col("o_orderstatus") == "F", "GET").otherwise("post")))


@query()
def webhook_detail_match(t):
    """Callbacks of each customer: the orders of one half stand for the inventory, those of the other for details."""
    own = t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("ord"), F.lit("POST").alias("method"), F.lit(None).cast("string").alias("path"), "o_orderpriority", "o_orderstatus")
    known = own.where("ord % 2 = 0").withColumns({"locators": F.array("o_orderpriority"), "sources": F.array("o_orderstatus")})
    return planning.match_webhooks(known, own.where("ord % 2 = 1").withColumns({"locator": F.col("o_orderpriority"), "source": F.col("o_orderstatus")}))


@query("""WITH b AS (SELECT p_size AS run, p_partkey AS ord, regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '_', 'g') || '_x' AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY run, base ORDER BY ord) AS r FROM b)
SELECT run, ord, CASE WHEN r > 1 THEN base || '_' || r ELSE base END AS key FROM n""")
def schema_component_keys(t):
    rows = t.part.select(F.col("p_size").alias("run"), F.col("p_partkey").alias("ord"), F.concat("p_brand", F.lit(" (x)")).alias("name"))
    return planning.schema_keys(rows).select("run", "ord", "key")


@query("WITH n AS (SELECT o_custkey AS run, o_orderkey AS ord, o_orderpriority AS base, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 4 <> 0) SELECT run, ord, CASE WHEN r > 1 THEN base || r ELSE base END AS key FROM n")
def webhook_component_keys(t):
    path = F.when(F.col("o_orderkey") % 4 == 0, "/p")
    rows = t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("ord"), F.lit("POST").alias("method"), path.alias("path"), F.concat("o_orderpriority", F.lit(": sent when "), F.col("o_orderkey").cast("string")).alias("summary"))
    return planning.webhook_keys(rows).select("run", "ord", "key")


@query("""WITH p AS (SELECT p_partkey AS owner, lower(replace(p_brand, '#', '')) AS b, p_size % 2 = 0 AS r, p_size % 5 = 0 AS u FROM part)
SELECT owner, 'item' AS path, '' AS parent, CASE WHEN u THEN 'union' ELSE 'array' END AS kind, r AS required FROM p UNION ALL SELECT owner, 'item.' || b, 'item', 'field', true FROM p WHERE NOT u UNION ALL SELECT owner, 'item.size', 'item', 'object', false FROM p WHERE NOT u UNION ALL SELECT owner, 'item.size.unit', 'item.size', 'field', false FROM p WHERE NOT u""")
def nested_field_tree(t):
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    even, union = F.col("p_size") % 2 == 0, F.col("p_size") % 5 == 0
    field = lambda name, required, one_of: F.struct(name.alias("name"), required.alias("required"), one_of.alias("is_union"))
    no, yes = F.lit(False), F.lit(True)
    made = F.array(field(F.concat(F.lit("item[]."), brand), yes, no), field(F.lit("item"), even, union), field(F.lit("item[].size.unit"), no, no))
    rows = t.part.select(F.col("p_partkey").alias("owner"), F.posexplode(made).alias("ord", "f")).select("owner", "ord", "f.*")
    return planning.nested_fields(rows).select("owner", "path", "parent", "kind", "required")


@query("""WITH RECURSIVE r AS (SELECT o_orderkey AS owner, o_orderkey AS node FROM orders WHERE o_orderkey % 8 = 0 UNION SELECT r.owner, o.o_orderkey FROM r JOIN orders o ON o.o_orderkey = r.node + 1 WHERE o.o_orderkey % 8 <> 0)
SELECT DISTINCT owner, lower(o_orderpriority) AS name FROM r JOIN orders ON o_orderkey = node""")
def harvested_names(t):
    keys = t.orders.select("o_orderkey")
    refs = keys.where("(o_orderkey + 1) % 8 != 0").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") + 1).alias("to_node"))
    return planning.reachable_names(t.orders.select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("name")), refs, keys.where("o_orderkey % 8 = 0").select(F.col("o_orderkey").alias("owner")))


#: A document for each part: an operation whose response has a schema by reference, or one that leads nowhere, and a webhook.
DOCUMENT = """concat('{"paths": {"/p/', p_partkey, '": {"get": {"responses": {"200": {"content": {"json": {"schema": {"$ref": "#/components/schemas/', CASE WHEN p_size % 3 = 0 THEN 'Gone' ELSE 'Part' END, '"}}}}}}, "summary": "s"}}, "webhooks": {"w": {"POST": {}}}, "components": {"schemas": {"Part": {"properties": {"a": {"type": "string"}, "self": {"$ref": "#/components/schemas/Part"}', repeat(', "b": {"type": "array", "items": {"oneOf": [{"type": "string"}, {"type": "number"}]}}', p_size % 2), '}}}}}')"""


def _documents(t):
    return t.part.select("p_partkey", F.expr(DOCUMENT).alias("j"))


@query("SELECT p_partkey, 'path' AS kind, '/p/' || p_partkey AS path, 'get' AS method FROM part UNION ALL SELECT p_partkey, 'webhook', 'w', 'post' FROM part")
def operation_map(t):
    return openapi.operation_map(_documents(t), "j", ["p_partkey"]).select("p_partkey", "kind", "path", "method")


@query("WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 + 2 * (p_size % 2) END::BIGINT AS fields FROM part) SELECT p_partkey, 1::BIGINT AS operations, (fields > 0)::BIGINT AS usable, (fields = 0)::BIGINT AS hollow, fields FROM c")
def response_contract_metrics(t):
    return openapi.response_contracts(_documents(t), "j", ["p_partkey"]).drop("hollow_locations")


@query("SELECT p_partkey, '#/components/schemas/Gone' AS ref FROM part WHERE p_size % 3 = 0")
def dangling_pointers(t):
    return openapi.dangling_refs(json_leaves(_documents(t), "j", ["p_partkey"]), ["p_partkey"]).select("p_partkey", "ref")


@query("SELECT p_size AS run, count(*) AS operations, count(*) AS paths, count(*) AS webhooks, count(DISTINCT p_brand) AS schemas FROM part GROUP BY p_size")
def contract_counts(t):
    ops = openapi.operation_map(t.part.select("p_size", F.expr(DOCUMENT).alias("j")), "j", ["p_size"]).withColumnRenamed("p_size", "run")
    return openapi.contract_counts(ops, t.part.select(F.col("p_size").alias("run"), F.col("p_brand").alias("name")), ["run"])


@query("""WITH e AS (SELECT l_partkey AS run, l_orderkey || '.' || l_linenumber AS location, l_returnflag AS f, l_linenumber AS n FROM lineitem),
x AS (SELECT run, location, CASE WHEN n % 4 = 0 THEN 'UNSUPPORTED_ASSERTION' WHEN f = 'R' THEN 'SOURCE_CONFLICT' WHEN f = 'A' THEN 'SOURCE_UNVERIFIED' END AS code FROM e) SELECT * FROM x WHERE code IS NOT NULL UNION ALL SELECT run, location, 'OUTPUT_MISMATCH' FROM e WHERE run NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def integration_findings(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("run"), F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("location"), "l_returnflag", "l_linenumber")
    entries = rows.withColumn("status", F.expr("CASE l_returnflag WHEN 'R' THEN 'conflicting' WHEN 'A' THEN 'unverified' ELSE 'supported' END"))
    refs = rows.select("run", "location", F.lit("op").alias("ref"))
    return planning.integration_findings(entries, rows.where("l_linenumber % 4 != 0"), refs, t.part.where("p_size > 5").select(F.col("p_partkey").alias("run"), F.lit("op").alias("ref")))


@query("""WITH o AS (SELECT o_custkey AS run, o_orderkey AS ord, 'operations.' || o_orderkey AS location, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'operation:GET:/' || o_orderpriority END AS identity, o_orderkey % 3 AS nr, o_orderkey % 5 AS ne FROM orders), n AS (SELECT *, coalesce(identity, location) AS name, min(CASE WHEN identity IS NOT NULL THEN ord END) OVER (PARTITION BY run, identity) AS first FROM o)
SELECT run, 'OPERATION_IDENTITY_INVALID' AS code, location, location AS message FROM n WHERE identity IS NULL UNION ALL SELECT run, 'OPERATION_IDENTITY_DUPLICATE', location, name FROM n WHERE identity IS NOT NULL AND ord > first UNION ALL SELECT run, 'RESPONSE_REQUIRED', location, name FROM n WHERE nr = 0 UNION ALL SELECT run, 'OPERATION_EVIDENCE_REQUIRED', location, name FROM n WHERE ne = 0""")
def operation_rule_findings(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("operations."), F.col("o_orderkey").cast("string")).alias("location"), F.when(F.col("o_orderkey") % 13 == 0, "FETCH").otherwise(" get").alias("method"),
        F.concat(F.lit("/"), "o_orderpriority").alias("path"), (F.col("o_orderkey") % 3).alias("n_responses"), (F.col("o_orderkey") % 5).alias("n_evidence"),
    )
    return domain.operation_findings(rows)


@query("""WITH e AS (SELECT l_orderkey AS run, CASE WHEN l_linenumber % 2 = 0 THEN 'explicit_support' WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'insufficient' END AS rel, l_linestatus AS path FROM lineitem), g AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE rel = 'explicit_support') AS s, count(*) FILTER (WHERE rel = 'contradicts') AS a, count(DISTINCT path) FILTER (WHERE rel = 'explicit_support' AND path IN ('F', 'O')) AS c FROM e GROUP BY run),
m AS (SELECT o_orderkey AS run, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(a, 0) AS a, coalesce(c, 0) AS c, o_orderstatus <> 'P' AS needs FROM orders LEFT JOIN g ON run = o_orderkey)
SELECT run, 'CLAIM_EVIDENCE_REQUIRED' AS code FROM m WHERE needs AND n = 0 UNION ALL SELECT run, 'CLAIM_SEMANTIC_SUPPORT_REQUIRED' FROM m WHERE needs AND s = 0 UNION ALL SELECT run, 'CLAIM_SUPPORT_COVERAGE_INCOMPLETE' FROM m WHERE needs AND s > 0 AND c < 2 UNION ALL SELECT run, 'CLAIM_EVIDENCE_CONTRADICTS' FROM m WHERE a > 0""")
def claim_rule_findings(t):
    here = F.lit("claims.0").alias("location")
    rel = F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'explicit_support' WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'insufficient' END")
    proof = t.lineitem.select(F.col("l_orderkey").alias("run"), here, F.lit("r").alias("relationship_id"), rel.alias("relationship"), F.col("l_linestatus").alias("claim_path"))
    own = t.orders.select(F.col("o_orderkey").alias("run"), here, F.col("o_orderkey").cast("string").alias("identity"), F.when(F.col("o_orderstatus") == "P", "unverified").otherwise("supported").alias("status"))
    paths = own.select("run", "location", F.explode(F.array(F.lit("F"), F.lit("O"))).alias("path"))
    return domain.claim_findings(own, proof, paths).select("run", "code")


@query("SELECT DISTINCT l_orderkey AS run, 'SCHEMA_REFERENCE_UNRESOLVED' AS code, l_linenumber::VARCHAR AS location, l_partkey::VARCHAR AS message FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unresolved_references(t):
    refs = t.lineitem.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("string").alias("location"), F.lit("schema").alias("kind"), F.col("l_partkey").cast("string").alias("ref"))
    known = t.lineitem.join(t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    return domain.reference_findings(refs, known.select(F.col("l_orderkey").alias("run"), F.lit("schema").alias("kind"), F.col("l_partkey").cast("string").alias("name")))


@query("""WITH p AS (SELECT p_partkey AS run, p_size % 4 AS form, p_size % 2 AS two, p_brand FROM part),
r AS (SELECT run, stage, NULL AS query_id, -1 AS ord, 'missing' AS kind, NULL AS status, NULL AS source, 'no structured answer' AS detail, NULL AS payload FROM p, (VALUES ('03'), ('04'), ('08'), ('09')) v(stage)
UNION ALL SELECT run, '05', 'q5', -1, 'missing', NULL, NULL, 'no structured answer', NULL FROM p WHERE form = 2
UNION ALL SELECT run, '05', 'q5', -1, 'missing', NULL, NULL, 'malformed shape for endpoints', NULL FROM p WHERE form = 0
UNION ALL SELECT run, '05', 'q5', i, 'missing', NULL, NULL, told, NULL FROM p, (VALUES (0, 'gap'), (1, '{"a":7}')) v(i, told) WHERE form = 0
UNION ALL SELECT run, '05', 'q5', 0, 'item', 'supported', 'd2', '/p' || run, '{"method":"GET","path":"/p' || run || '","source":"B.md"}' FROM p WHERE form = 1
UNION ALL SELECT run, '05', 'q5', i, 'missing', NULL, NULL, 'malformed item in endpoints', wrong FROM p, (VALUES (1, 'method'), (2, NULL)) v(i, wrong) WHERE form = 1
UNION ALL SELECT run, '05', 'q5', 0, 'conflict', NULL, NULL, 'c', NULL FROM p WHERE form = 1
UNION ALL SELECT run, '07', 'q7', 0, 'item', CASE two WHEN 0 THEN 'supported' ELSE 'unverified' END, CASE two WHEN 0 THEN 'd1' END, p_brand, '{"enums":"","fields":[{"name":"x"}],"name":"' || p_brand || '"}' FROM p
UNION ALL SELECT run, '07', 'q7', 1, 'missing', NULL, NULL, 'malformed item in schemas', 'fields' FROM p)
SELECT * FROM r""")
def coerced_answers(t):
    """Structured answers about every part, of several shapes; some have a later answer, or one without structure."""
    run, form = F.col("p_partkey").alias("run"), F.col("p_size") % 4
    whole = F.concat(F.lit('```json\n{"endpoints": [{"path": "/p'), F.col("p_partkey").cast("string"), F.lit('", "method": "GET", "source": "B.md"}, {"method": 5, "path": "/x"}, "odd"], "conflicts": ["c"]}\n```'))
    first = t.part.select(run, F.lit("05").alias("stage"), F.lit(0).alias("ord"), F.lit("q5").alias("query_id"), F.when(form == 0, '{"endpoints": {"a": 1}, "missing": ["gap", {"a": 7}]}').when(form == 2, "none").otherwise(whole).alias("answer"))
    later = t.part.where(form == 3).select(run, F.lit("05"), F.lit(1), F.lit("q5b"), F.lit('Nothing: {"endpoints": []}'))
    schemas = t.part.select(run, F.lit("07"), F.lit(0), F.lit("q7"), F.concat(F.lit('{"schemas": [{"name": "'), "p_brand", F.lit('", "fields": [{"name": "x"}], "enums": ""}, {"name": "b", "fields": ["x"]}]}')))
    names = F.array(F.struct(F.lit("d1").alias("document"), F.lit("a.md").alias("name")), F.struct(F.lit("d2").alias("document"), F.lit("b.md").alias("name")))
    manifest = t.part.select(run, F.explode(F.when(F.col("p_size") % 2 == 1, names).otherwise(F.slice(names, 1, 1))).alias("d")).select("run", "d.*")
    return answers.coerced_items(first.unionAll(later).unionAll(schemas), manifest)
