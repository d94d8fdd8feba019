"""Queries over pages and Markdown sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import facts, tables
from attestor.plans.registry import query
from attestor.sources import artifacts, html

#: A small API description in Markdown, as rows of every source of the documents table.
GUIDE = """# Orders
GET /orders/{id}

| Name | Type |
| --- | --- |
| id | string |
| `expand` (optional) | string |

```json
{"GET": "/not/an/endpoint"}
```

## Errors
| Code | Meaning |
| --- | --- |
| E100 | gone |

# Payments
| URL | https://api.example.com/pay | Method | POST |

| Parameter | Type |
| --- | --- |
| amount | number |
"""


def _guides(t):
    return t.documents.select("source").distinct().select(F.concat("source", F.lit(".md")).alias("path"), F.lit(GUIDE).alias("text"))


GUIDE_SQL = "s AS (SELECT DISTINCT source || '.md' AS source FROM documents)"


@query(f"WITH {GUIDE_SQL} SELECT source, method, path, line, last_line, n_fences, parameters FROM s, (VALUES ('GET', '/orders/{{id}}', 2, 17, 1::BIGINT, 'expand,id'), ('POST', '/pay', 19, 24, 0::BIGINT, 'amount')) v(method, path, line, last_line, n_fences, parameters)")
def markdown_endpoint_facts(t):
    return facts.endpoint_facts(_guides(t), "path", "text").withColumn("parameters", F.array_join("parameters", ","))


@query(f"WITH {GUIDE_SQL} SELECT source, 2 AS line, 'GET' AS method, '/orders/{{id}}' AS path FROM s")
def markdown_drafts(t):
    return facts.draft_endpoints(_guides(t), "path", "text")


@query("SELECT 'ep01.json' AS file, 'GET' AS method, '/orders/{id}' AS path, min(source || '.md') AS source, 2 AS line FROM documents")
def extraction_scaffold(t):
    return facts.scaffold(facts.first_drafts(facts.draft_endpoints(_guides(t), "path", "text")), 1)


@query(r"""WITH d AS (SELECT doc_id AS source, string_split(text || chr(10) || 'get /documents/' || doc_id || chr(10) || 'POST `/documents`', chr(10)) AS ls FROM documents), l AS (SELECT source, ls, unnest(range(1, len(ls) + 1))::INT AS line FROM d),
m AS (SELECT source, line, regexp_extract(ls[line], '(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+`?(/[A-Za-z0-9_{}./:-]*)', ['method', 'path']) AS e FROM l WHERE regexp_matches(ls[line], '(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+`?(/[A-Za-z0-9_{}./:-]*)'))
SELECT printf('ep%02d.json', row_number() OVER (ORDER BY source, line, upper(e.method), e.path) - 1) AS file, upper(e.method) AS method, e.path AS path, source, line FROM m""")
def extraction_scaffold_whole(t):
    """Every draft of every document, each of which gets two lines that name endpoints."""
    text = F.concat("text", F.lit("\nget /documents/"), "doc_id", F.lit("\nPOST `/documents`"))
    return facts.scaffold(facts.draft_endpoints(t.documents.select("doc_id", text.alias("text")), "doc_id", "text"))


@query("SELECT 'GET' AS method, '/orders/{id}' AS path, count(DISTINCT source) AS units, 1::BIGINT AS n_fences, 'expand,id' AS parameters FROM documents UNION ALL SELECT 'POST', '/pay', count(DISTINCT source), 0, 'amount' FROM documents")
def merged_facts(t):
    return facts.merge_facts(facts.endpoint_facts(_guides(t), "path", "text")).withColumn("parameters", F.array_join("parameters", ","))


@query("SELECT doc_id AS source, i AS line, string_split(text, chr(10))[i] AS text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS i FROM documents)")
def document_lines(t):
    return facts.lines(t.documents, "doc_id", "text")


RUN = r"^ {0,3}(`{3,}|~{3,})(.*)$"


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id AS source, string_split(text || CASE doc_id % 4 WHEN 0 THEN chr(10) || '~~~~ text' || chr(10) || '```' || chr(10) || '~~~' WHEN 1 THEN chr(10) || '```' || chr(10) || '````' ELSE '' END, chr(10)) AS ls FROM documents),
l AS (SELECT source, unnest(range(1, len(ls) + 1))::INT AS i, ls FROM d),
m AS (SELECT source, i, row_number() OVER (PARTITION BY source ORDER BY i) AS k, regexp_extract(ls[i], '{RUN}', 1) AS run, trim(regexp_extract(ls[i], '{RUN}', 2)) AS info FROM l WHERE regexp_matches(ls[i], '{RUN}')),
f AS (SELECT source, k, run AS mark, i AS opened FROM m WHERE k = 1
  UNION ALL SELECT m.source, m.k, CASE WHEN f.mark = '' THEN m.run WHEN m.info = '' AND starts_with(m.run, f.mark) THEN '' ELSE f.mark END, CASE WHEN f.mark = '' THEN m.i ELSE f.opened END FROM f JOIN m ON m.source = f.source AND m.k = f.k + 1)
SELECT f.source, opened FROM f JOIN (SELECT source, max(k) AS k FROM m GROUP BY source) USING (source, k) WHERE mark <> ''""")
def unclosed_fences(t):
    """All documents; half of them end in fences of both kinds."""
    more = F.expr(r"CASE doc_id % 4 WHEN 0 THEN '\n~~~~ text\n```\n~~~' WHEN 1 THEN '\n```\n````' ELSE '' END")
    return facts.unclosed_fences(t.documents.select("doc_id", F.concat("text", more).alias("text")), "doc_id", "text")


@query()
def document_endpoint_facts(t):
    """Endpoint facts of all documents, each followed by a section that declares an endpoint, its parameters and an example."""
    section = F.concat(F.lit("\n# Section "), "doc_id", F.lit("\nGET /"), "source", F.lit("/{id}\n\n| Name | Type |\n| --- | --- |\n| id | string |\n| "), "lang", F.lit(" | string |\n\n```json\n| Name | x |\n```\n# End\n| Name |\n| --- |\n| other |\n"))
    return facts.endpoint_facts(t.documents.select("doc_id", F.concat("text", section).alias("text")), "doc_id", "text").withColumn("parameters", F.array_join("parameters", ","))


@query("""SELECT doc_id AS source, method, path, info, start_line, end_line, replace(excerpt, '{}', doc_id::VARCHAR) AS excerpt FROM documents,
(VALUES ('GET', '/a', 'json', 3, 6, '{"a":' || chr(10) || ' {}}'), ('GET', '/a', '', 10, 13, '  [{}]'), ('POST', '/b', 'text', 18, 21, '<b>' || chr(10) || '```'), ('POST', '/b', 'http', 22, 23, '')) v(method, path, info, start_line, end_line, excerpt) WHERE text IS NOT NULL""")
def document_payload_fences(t):
    """Example fences of every document, which follows sections of two endpoints."""
    head = F.concat(F.lit('# A\nGET /a\n``` JSON\n{"a":  \n '), "doc_id", F.lit("}\n```\n~~~ text\nplain {\n~~~\n```\n\n  ["), "doc_id", F.lit("]\n```\n# B\n```json\n```\nPOST /b\n~~~ text\n<b>\n```\n~~~\n``` http\n```\n# Text\n"))
    return facts.payload_fences(t.documents.select("doc_id", F.concat(head, "text").alias("text")), "doc_id", "text")


@query()
def section_owner_window(t):
    """The endpoint that owns each line of all documents, each of which declares two of its own."""
    body = F.concat(F.lit("# One\nGET /a\n"), "text", F.lit("\n## Two\nstill one\n# Three\nPOST /b\nlast"))
    rows = facts.section_owner(facts.marked_lines(t.documents.select("doc_id", body.alias("text")), "doc_id", "text"))
    return rows.where("owner is not null").groupBy("source", "owner.method", "owner.path").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n"))


@query()
def page_markdown(t):
    return t.pages.select("page_id", html.page_markdown("html").alias("markdown"))


@query()
def page_metadata(t):
    return t.pages.select("page_id", html.page_metadata("html").alias("m")).select("page_id", "m.*")


@query()
def navigation_catalog(t):
    return html.catalog(t.pages)


@query("""SELECT p_partkey, 0 AS "table", row, col, CASE text WHEN 'name' THEN p_name WHEN 'brand' THEN p_brand WHEN 'size' THEN p_size::VARCHAR ELSE text END AS text
FROM part, (VALUES (0, 0, 'a'), (0, 1, 'b'), (0, 2, 'c'), (1, 0, 'name'), (1, 1, ''), (1, 2, 'brand'), (2, 0, 'size'), (2, 1, 'z'), (2, 2, 'brand')) v(row, col, text)""")
def html_table_grid(t):
    """Cells of a table about every part, some of which span columns or rows.

    Parts are dealt out before their tables are parsed: a small file of many rows is otherwise one task's.
    """
    table = F.concat(F.lit("<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td colspan=2>"), "p_name", F.lit("</td><td rowspan=2>"), "p_brand", F.lit("</td></tr><tr><td>"), F.col("p_size").cast("string"), F.lit("</td><td>z</td></tr></table>"))
    return t.part.select("p_partkey", "p_name", "p_brand", "p_size").repartition("p_partkey").select("p_partkey", F.explode(html.table_cells(table)).alias("c")).select("p_partkey", "c.*")


@query()
def html_snapshots(t):
    return html.snapshots(t.pages)


@query()
def page_corpus(t):
    from attestor.functions.urls import page_url

    nodes = html.catalog(t.pages)
    return html.corpus(nodes, t.pages.select(page_url(F.col("url")).alias("node_url"), "html").groupBy("node_url").agg(F.min("html").alias("html")))


@query("""SELECT url AS entry_url, i AS ordinal, label, u AS url, reason IS NULL AS accepted, reason FROM (SELECT DISTINCT 'https://' || source || '.example.com' AS url FROM documents), (VALUES (0, 'A', '/a.md', NULL), (1, 'B', '/b.html', 'not_markdown'), (2, 'A2', '/a.md', 'duplicate'), (3, 'C', '/../c.md', 'unsafe_path')) v(i, label, p, reason), LATERAL (SELECT url || p AS u)""")
def llms_index(t):
    base = t.documents.select(F.concat(F.lit("https://"), "source", F.lit(".example.com")).alias("entry_url")).distinct()
    line = lambda label, path: F.concat(F.lit(f"- [{label}]("), "entry_url", F.lit(f"{path})\n"))
    return html.llms_index(base.withColumn("text", F.concat(line("A", "/a.md"), line("B", "/b.html"), line("A2", "/a.md"), line("C", "/../c.md"))))


@query("SELECT doc_id AS source, 1 AS start_line, 2 AS end_line, CASE WHEN len(l) >= 2 THEN l[1] || chr(10) || l[2] END AS excerpt, CASE WHEN len(l) >= 2 THEN sha256(l[1] || chr(10) || l[2]) END AS digest, CASE WHEN len(l) >= 2 THEN 'exact' ELSE 'unresolved' END AS precision FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def evidence_fragments(t):
    docs = t.documents.select(F.col("doc_id").alias("source"), "text")
    return artifacts.line_fragments(docs, docs.select("source", F.lit(1).alias("start_line"), F.lit(2).alias("end_line")))


@query("SELECT url, CASE WHEN page_id % 7 <> 0 THEN CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END END AS http_status, CASE WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 THEN sha256(html) END AS content_sha256, CASE WHEN page_id % 7 = 0 THEN 'timeout' WHEN page_id % 5 = 0 THEN 'HTTP 404' END AS note FROM pages")
def url_probe_rows(t):
    landed = t.pages.select("url", F.expr("CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END").alias("status"), F.encode("html", "UTF-8").alias("content"), F.expr("CASE WHEN page_id % 7 = 0 THEN 'timeout' END").alias("error"))
    return artifacts.url_sources(landed)


def _part_guides(t):
    """A Markdown guide of every part: a table of parameters, with an error table stuck to it or not, one of constants, and one of codes."""
    size = F.col("p_size")
    body = F.concat(
        F.lit("# "), "p_name", F.lit("\nGET /parts/"), F.col("p_partkey").cast("string"),
        F.lit("\n| 參數 | Request_Field | Type | Required |\n|---|---|---|---|\n| 大小 | size | int | yes |\n| Header | | | |\n| 品牌 | **brand** (new) | str | no |\n| 接受 | Accept | str | |\n"),
        F.when(size % 3 == 0, "| **Error code:** | | | |\n| 0 | ok | | |\n").otherwise(""), F.lit("\n| Name | Value |\n|---|---|\n| Content-Type | application/json |\n\n## Error handling\n### Payment\n| Code | Meaning |\n|---|---|\n| `E"), size.cast("string"), F.lit("` | odd |\n| 支付類 | |\n"),
        F.when(size % 4 == 0, "| not a code! | y |\n").otherwise(""), F.lit("\n## Else\n| Code | Currency |\n|---|---|\n| USD | dollar |\n"),
    )
    docs = t.part.select("p_partkey", body.alias("body"))
    return tables.tables(facts.section_owner(facts.landmarks(facts.marked_lines(docs, "p_partkey", "body"))))


@query("SELECT p_partkey, 'GET' AS method, '/parts/' || p_partkey AS path, name, required FROM part, (VALUES ('size', 'true'), ('brand', 'false')) v(name, required)")
def guide_parameters(t):
    """Parameters that the tables of each part's guide list."""
    return tables.table_parameters(_part_guides(t)).select(F.col("source").alias("p_partkey"), "method", "path", "name", "required")


@query("SELECT p_partkey, 'E' || p_size AS code, 'odd' AS meaning FROM part WHERE p_size % 4 <> 0")
def guide_error_codes(t):
    """Error codes that whole tables of each part's guide document."""
    return tables.error_codes(_part_guides(t)).select(F.col("source").alias("p_partkey"), "code", "meaning")
