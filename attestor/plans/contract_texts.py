"""Queries that write out the contract of each part: its order lines are the operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import projections
from attestor.plans.registry import query


def _line() -> list:
    """What tells order lines apart."""
    return [F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")]


def contract_tables(t) -> dict[str, DataFrame]:
    null = F.lit(None).cast("string")
    own = t.lineitem.select(F.col("l_partkey").alias("contract"), F.when(F.col("l_returnflag") == "R", "POST").otherwise("GET").alias("method"), F.concat_ws("/", F.lit("/lines"), *_line()).alias("path"), "l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
    parts = t.part.select(F.col("p_partkey").alias("contract"), "p_name", "p_size", "p_brand")
    keys = ["contract", "method", "path"]
    schemas = parts.select("contract", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name")) for i, n in enumerate(("Part", "Line"))])).alias("s")).select("contract", "s.*")
    fields = [("Line", 0, "id", "integer", None, True), ("Line", 1, "part", "string", "Part", False), ("Line", 2, "note", None, None, False), ("Part", 0, "name", "string", None, False)]
    made = F.array(*[F.struct(F.lit(s).alias("schema"), F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(k).cast("string").alias("type"), F.lit(r).cast("string").alias("schema_ref"), F.lit(q).alias("required")) for s, i, n, k, r, q in fields])
    return {
        "contracts": parts.select("contract", F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1."), "p_size")).alias("version")),
        "environments": parts.where("p_size % 3 = 0").select("contract", F.lit(0).alias("ord"), F.col("p_brand").alias("name"), F.array(F.lit("https://a.example"), F.lit("https://b.example")).alias("servers")),
        "schemas": schemas,
        "fields": parts.select("contract", F.explode(made).alias("f")).select("contract", "f.*"),
        "operations": own.select(*keys, F.when(F.col("l_linestatus") == "O", F.concat(F.lit('An "open" line '), "l_linenumber")).alias("summary"), F.when(F.col("l_returnflag") == "R", "Line").alias("request_schema_ref"), F.when(F.col("l_quantity") > 40, F.array(F.lit("key"))).otherwise(F.array().cast("array<string>")).alias("security")),
        "parameters": own.where("l_quantity > 10").select(*keys, F.lit(0).alias("ord"), F.lit("qty").alias("name"), F.lit("query").alias("location"), F.when(F.col("l_quantity") > 25, True).alias("required"), null.alias("schema_ref")),
        "responses": own.select(*keys, F.lit("200").alias("status"), null.alias("description"), F.lit("Line").alias("schema_ref")).unionAll(own.where("l_returnflag = 'A'").select(*keys, F.lit("404"), F.lit("gone"), null)),
        "security": parts.where("p_size % 5 = 0").select("contract", F.lit("key").alias("name"), F.lit("apiKey").alias("type")),
    }


_OWN = """o AS (SELECT l_partkey AS contract, CASE WHEN l_returnflag = 'R' THEN 'POST' ELSE 'GET' END AS method, '/lines/' || l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || strftime(l_shipdate, '%Y%m%d') AS path, l_returnflag, l_linestatus, l_quantity, l_linenumber FROM lineitem)"""
_OPENAPI_SQL = rf"""WITH {_OWN},
p AS (SELECT contract, path, '"' || path || '":{{"' || lower(method) || '":{{'
  || CASE WHEN l_quantity > 10 THEN '"parameters":[{{"in":"query","name":"qty"' || CASE WHEN l_quantity > 25 THEN ',"required":true' ELSE '' END || '}}],' ELSE '' END
  || CASE WHEN l_returnflag = 'R' THEN '"requestBody":{{"content":{{"application/json":{{"schema":{{"$ref":"#/components/schemas/Line"}}}}}}}},' ELSE '' END
  || '"responses":{{"200":{{"content":{{"application/json":{{"schema":{{"$ref":"#/components/schemas/Line"}}}}}},"description":""}}' || CASE WHEN l_returnflag = 'A' THEN ',"404":{{"description":"gone"}}' ELSE '' END || '}}'
  || CASE WHEN l_quantity > 40 THEN ',"security":[{{"key":[]}}]' ELSE '' END
  || CASE WHEN l_linestatus = 'O' THEN ',"summary":"An \"open\" line ' || l_linenumber || '"' ELSE '' END || '}}}}' AS text FROM o),
a AS (SELECT contract, string_agg(text, ',' ORDER BY path) AS paths FROM p GROUP BY contract)
SELECT p_partkey AS contract, '{{"components":{{"schemas":{{"Line":{{"properties":{{"id":{{"type":"integer"}},"note":{{}},"part":{{"$ref":"#/components/schemas/Part"}}}},"required":["id"],"type":"object"}},"Part":{{"properties":{{"name":{{"type":"string"}}}},"type":"object"}}}},"securitySchemes":{{'
  || CASE WHEN p_size % 5 = 0 THEN '"key":{{"type":"apiKey"}}' ELSE '' END || '}}}},"info":{{"title":"' || p_name || '","version":"' || CASE WHEN p_size % 2 = 0 THEN '1.' || p_size ELSE '0.0.0' END || '"' || CASE WHEN p_size % 2 = 1 THEN ',"x-loop-status":"missing-source"' ELSE '' END
  || '}},"openapi":"3.1.0","paths":{{' || coalesce(paths, '') || '}},"servers":[' || CASE WHEN p_size % 3 = 0 THEN '{{"description":"' || p_brand || '","url":"https://a.example"}},{{"description":"' || p_brand || '","url":"https://b.example"}}' ELSE '' END || ']}}' AS content, NULL::VARCHAR AS error
FROM part LEFT JOIN a ON p_partkey = contract"""


@query(_OPENAPI_SQL)
def openapi_projection(t):
    """The OpenAPI document of every part's contract."""
    return projections.openapi_documents(contract_tables(t))


@query(rf"""WITH {_OWN},
s AS (SELECT contract, path, method, '## ' || method || ' ' || path || CASE WHEN l_linestatus = 'O' THEN chr(10) || chr(10) || 'An "open" line ' || l_linenumber ELSE '' END
  || CASE WHEN l_quantity > 10 THEN chr(10) || chr(10) || '| name | in | required | schema |' || chr(10) || '|---|---|---|---|' || chr(10) || '| qty | query | ' || CASE WHEN l_quantity > 25 THEN 'true' ELSE '' END || ' |  |' ELSE '' END
  || chr(10) || chr(10) || '| status | description | schema |' || chr(10) || '|---|---|---|' || chr(10) || '| 200 |  | Line |' || CASE WHEN l_returnflag = 'A' THEN chr(10) || '| 404 | gone |  |' ELSE '' END || chr(10) AS text FROM o),
a AS (SELECT contract, chr(10) || string_agg(text, chr(10) ORDER BY path, method) AS sections FROM s GROUP BY contract)
SELECT p_partkey AS contract, '# ' || p_name || chr(10) || coalesce(sections, '') AS content FROM part LEFT JOIN a ON p_partkey = contract""")
def markdown_projection(t):
    """The Markdown guide of every part's contract."""
    return projections.markdown_documents(contract_tables(t))


@query("""WITH r AS (SELECT l_partkey AS contract, CASE l_returnflag WHEN 'R' THEN 'mutation' WHEN 'A' THEN 'subscription' ELSE 'query' END AS kind, 'line_' || l_orderkey || '_' || l_linenumber || '_' || l_suppkey || '_' || strftime(l_shipdate, '%Y%m%d') AS field, l_quantity FROM lineitem),
b AS (SELECT contract, kind, 'type ' || upper(kind[1]) || kind[2:] || ' {' || chr(10) || string_agg('  ' || field || ': Line' || CASE WHEN l_quantity > 25 THEN '!' ELSE '' END, chr(10) ORDER BY field) || chr(10) || '}' || chr(10) || chr(10) AS text FROM r GROUP BY contract, kind),
a AS (SELECT contract, string_agg(text, '' ORDER BY CASE kind WHEN 'query' THEN 0 WHEN 'mutation' THEN 1 ELSE 2 END) AS roots FROM b GROUP BY contract)
SELECT p_partkey AS contract, coalesce(roots, '') || 'type Part {' || chr(10) || '  name: string' || chr(10) || '}' || chr(10) || chr(10) || 'type Line {' || chr(10) || '  id: integer!' || chr(10) || '  part: Part' || chr(10) || '}' || chr(10) AS content, NULL::VARCHAR AS error FROM part LEFT JOIN a ON p_partkey = contract""")
def graphql_projection(t):
    """The GraphQL schema of every part, whose order lines are its root fields."""
    tables = contract_tables(t)
    kind = F.when(F.col("l_returnflag") == "R", "mutation").when(F.col("l_returnflag") == "A", "subscription").otherwise("query")
    own = t.lineitem.select(F.col("l_partkey").alias("contract"), F.lit("graphql").alias("transport"), kind.alias("operation_kind"), F.concat_ws("_", F.lit("line"), *_line()).alias("root_field"), F.lit("Line").alias("output_schema_ref"), (F.col("l_quantity") > 25).alias("output_required"))
    return projections.graphql_documents(tables | {"interactions": own, "fields": tables["fields"].where("name != 'note'")})
