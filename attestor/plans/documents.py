"""Queries over documents, labels and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import text, urls
from attestor.operators import compare, manifest, related, risk, scoring
from attestor.plans.registry import Tables, query

PATH = "concat(source, '/', lpad(doc_id, 12, '0'), CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.json' WHEN 2 THEN '.txt' ELSE '.html' END)"
PATH_SQL = "source || '/' || lpad(doc_id::VARCHAR, 12, '0') || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.json' WHEN 2 THEN '.txt' ELSE '.html' END"
FILES_SQL = f"files AS (SELECT {PATH_SQL} AS path, sha256(text) AS sha256, source, lang FROM documents)"
STATUS_SQL = f"""{FILES_SQL},
firsts AS (SELECT sha256, min(path) AS first FROM files WHERE path NOT LIKE '%.txt' GROUP BY sha256),
marked AS (SELECT f.*, CASE WHEN path LIKE '%.txt' THEN 'unsupported' WHEN path <> first THEN 'duplicate' ELSE 'pending' END AS status,
  CASE WHEN path NOT LIKE '%.txt' AND path <> first THEN first END AS duplicate_of FROM files f LEFT JOIN firsts USING (sha256))"""


def _files(t: Tables) -> DataFrame:
    return t.documents.select(F.expr(PATH).alias("path"), F.sha2("text", 256).alias("sha256"), "source", "lang")


@query(f"WITH {STATUS_SQL} SELECT path, sha256, status, duplicate_of FROM marked")
def manifest_dedup_status(t):
    return manifest.with_status(_files(t)).select("path", "sha256", "status", "duplicate_of")


@query(f"WITH {STATUS_SQL} SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'duplicate') AS n_duplicate FROM marked GROUP BY ROLLUP (source, lang)")
def manifest_status_rollup(t):
    return manifest.rollup_status(manifest.with_status(_files(t)), ["source", "lang"])


@query(f"WITH {FILES_SQL} SELECT path, CASE regexp_extract(path, '[.]([^.]+)$', 1) WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'openapi_json' WHEN 'txt' THEN 'plain_text' ELSE 'html' END AS format, path NOT LIKE '%.txt' AS supported FROM files")
def format_support_lookup(t):
    fmt = manifest.file_format(F.col("path"))
    return _files(t).select("path", fmt.alias("format"), (~fmt.isin(manifest.UNSUPPORTED)).alias("supported"))


@query("WITH f AS (SELECT CASE WHEN doc_id % 7 = 0 THEN source || '/README.' || doc_id WHEN doc_id % 7 = 1 THEN '.git/' || doc_id WHEN doc_id % 7 = 2 THEN doc_id || '.md.source.json' ELSE source || '/' || doc_id || '.md' END AS path FROM documents) SELECT path, (path LIKE '%/README%' OR path LIKE '.git/%' OR path LIKE '%.source.json') AS excluded FROM f")
def exclude_glob_filter(t):
    path = F.expr("CASE WHEN doc_id % 7 = 0 THEN concat(source, '/README.', doc_id) WHEN doc_id % 7 = 1 THEN concat('.git/', doc_id) WHEN doc_id % 7 = 2 THEN concat(doc_id, '.md.source.json') ELSE concat(source, '/', doc_id, '.md') END")
    files = t.documents.select(path.alias("path"))
    return files.select("path", manifest.is_excluded(F.col("path")).alias("excluded"))


@query("WITH e AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b[^\\s@]{1,64}@(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\.){1,8}[a-z]{2,24}\\b'))::BIGINT AS n FROM documents) SELECT doc_id, n AS n_hits FROM e WHERE n > 0")
def risk_email_hits(t):
    rule = [r for r in risk.RULES if r[0] == "SR-CONTACT-PII"]
    return risk.rule_counts(t.documents, "text", ["doc_id"], rule).select("doc_id", "n_hits")


SIMPLE_RULES = [("SR-IPV4", "warning", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), ("SR-TOKEN", "blocker", r"(?i)token = "), ("SR-LONG-NUMBER", "warning", r"[0-9]{13,19}")]
RULES_SQL = """hits AS (
SELECT doc_id, lang, source, 'SR-IPV4' AS rule_id, 'warning' AS severity, len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'))::BIGINT AS n_hits FROM documents
UNION ALL SELECT doc_id, lang, source, 'SR-TOKEN', 'blocker', len(regexp_extract_all(text, '(?i)token = '))::BIGINT FROM documents
UNION ALL SELECT doc_id, lang, source, 'SR-LONG-NUMBER', 'warning', len(regexp_extract_all(text, '[0-9]{13,19}'))::BIGINT FROM documents)"""


@query(f"WITH {RULES_SQL} SELECT doc_id, rule_id, severity, n_hits FROM hits WHERE n_hits > 0")
def risk_rule_counts(t):
    return risk.rule_counts(t.documents, "text", ["doc_id"], SIMPLE_RULES)


@query(f"WITH {RULES_SQL}, g AS (SELECT source, sum(CASE WHEN severity = 'blocker' THEN n_hits ELSE 0 END)::BIGINT AS n_blockers, sum(CASE WHEN severity = 'warning' THEN n_hits ELSE 0 END)::BIGINT AS n_warnings FROM hits WHERE n_hits > 0 GROUP BY source) SELECT *, CASE WHEN n_blockers > 0 THEN 'reject' WHEN n_warnings > 0 THEN 'review' ELSE 'accept' END AS verdict FROM g")
def risk_verdict_by_source(t):
    return risk.verdicts(risk.rule_counts(t.documents, "text", ["source"], SIMPLE_RULES), ["source"])


@query()
def risk_findings(t):
    """All rules of the pack with line and column, payment cards included, over all documents."""
    return risk.findings(t.documents, "text", ["doc_id"])


def _re2(pattern: str) -> str:
    """A pattern as DuckDB takes it."""
    return pattern.replace("'", "''")


PACK = [r for r in risk.RULES if r[0] not in ("SR-PII-VALUE", "SR-ZERO-WIDTH-FORMATTING")]  # what regular expressions without looking around can say
PACK_SQL = " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule_id, '{severity}' AS severity, len(regexp_extract_all(text, '{_re2(pattern)}'))::BIGINT AS n_hits FROM documents" for rule, severity, pattern in PACK if "\x00" not in pattern)


@query(f"SELECT * FROM ({PACK_SQL}) WHERE n_hits > 0")
def risk_pack_counts(t):
    """Hits of the pack's rules in every document, other than control characters, zero widths and personal data, which SQL can't say."""
    found = risk.findings(t.documents, "text", ["doc_id"])
    names = [r for r, _, p in PACK if "\x00" not in p]
    return found.where(F.col("rule_id").isin(names)).groupBy("doc_id", "rule_id", "severity").agg(F.count("*").alias("n_hits"))


@query()
def risk_card_candidates(t):
    from attestor.functions.cards import card_numbers

    return t.documents.select("doc_id", F.explode(card_numbers(F.col("text"))).alias("c")).select("doc_id", "c.*")


@query("""WITH w AS (SELECT doc_id, unnest(range(1, len(string_split(text, 'token = ')))) AS k, string_split(text, 'token = ') AS parts FROM documents WHERE contains(text, 'token = ')),
o AS (SELECT doc_id, list_sum(list_transform(parts[1:k], lambda p: length(p)))::INT + (k - 1)::INT * 8 AS "offset", parts FROM w),
b AS (SELECT doc_id, "offset", substr(array_to_string(parts, 'token = '), 1, "offset") AS before FROM o)
SELECT doc_id, 'SR-TOKEN' AS rule_id, 'blocker' AS severity, 0 AS rule_index, "offset", (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS line, (length(string_split(before, chr(10))[-1]) + 1)::INT AS "column" FROM b""")
def line_column_locator(t):
    return risk.findings(t.documents, "text", ["doc_id"], [("SR-TOKEN", "blocker", "token = ")], cards=False)


@query("""WITH f AS (SELECT doc_id, source, CASE WHEN quality = 0 THEN 'blocker' ELSE 'warning' END AS severity FROM labels JOIN documents USING (doc_id) WHERE quality = 0 OR toxic = 1),
b AS (SELECT * FROM f WHERE severity = 'blocker' ORDER BY source, doc_id LIMIT 99), w AS (SELECT * FROM f WHERE severity = 'warning' ORDER BY source, doc_id LIMIT 20)
SELECT * FROM (SELECT * FROM b UNION ALL SELECT * FROM w) ORDER BY source, doc_id LIMIT 99""")
def risk_capped_findings(t):
    rows = t.labels.where("quality = 0 or toxic = 1").join(t.documents.select("doc_id", "source"), "doc_id")
    return risk.first_findings(rows.select("doc_id", "source", F.when(F.col("quality") == 0, "blocker").otherwise("warning").alias("severity")), ["source", "doc_id"], 99, 20)


@query()
def risk_capped_report(t):
    """Findings of the rule pack over all documents under its documented caps, with what was cut."""
    return risk.capped(risk.findings(t.documents, "text", ["doc_id"]), ["doc_id", "offset", "rule_id", "rule_index"])


@query()
def risk_report(t):
    """The capped findings of a manifest of all documents, with what could not be scanned."""
    files = manifest.with_status(_files(t).join(t.documents.select(F.expr(PATH).alias("path"), "text"), "path"))
    sized = files.select("path", "sha256", "status", "format", "text", F.octet_length("text").cast("long").alias("size_bytes"), F.lit(True).alias("valid_utf8"))
    return risk.report(sized, "text", ["path"], max_bytes=20_000)


@query("SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url FROM pages")
def url_canonical(t):
    return t.pages.select("page_id", urls.page_url(F.col("url")).alias("url"))


@query("""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '([?][^#]*)', 1) AS url,
lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS origin FROM pages""")
def url_strict(t):
    return t.pages.select("page_id", urls.strict_url(F.col("url")).alias("url"), urls.origin(F.col("url")).alias("origin"))


@query("WITH o AS (SELECT DISTINCT lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS o FROM pages) SELECT o || p AS candidate FROM o, (VALUES ('/openapi.json'), ('/swagger.json'), ('/v3/api-docs'), ('/api-docs')) v(p)")
def spec_candidates(t):
    return t.pages.select(F.explode(urls.spec_candidates(F.col("url"))).alias("candidate")).distinct()


@query("""WITH e AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url FROM pages), r AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url FROM pages WHERE page_id % 3 <> 0)
SELECT url FROM e EXCEPT SELECT url FROM r""")
def url_coverage_missing(t):
    return manifest.never_fetched(t.pages, t.pages.where("page_id % 3 != 0"))


HREF = r'<a href="([^"]*)"'
LINKS_SQL = "links AS (SELECT page_id AS page, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages)"


@query(f"WITH {LINKS_SQL} SELECT page AS page_id, href, count(*) AS n FROM links GROUP BY ALL")
def page_links_explode(t):
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT page_id, (length(trim(html)) < 500 AND (contains(lower(html || chr(10) || html), 'enable javascript') OR contains(lower(html), 'javascript is required') OR contains(lower(html), 'javascript enabled') OR contains(lower(html), 'requires javascript') OR contains(lower(html), 'without javascript') OR (contains(lower(html), '<noscript>') AND contains(lower(html), 'javascript')))) AS shell FROM pages")
def page_spa_shell(t):
    return t.pages.select("page_id", text.spa_shell(F.col("html"), F.col("html")).alias("shell"))


RELATED_SQL = f"""WITH {LINKS_SQL}, branch AS (SELECT page_id AS page, regexp_extract(url, '://([^/]*)', 1) AS branch FROM pages),
ent AS (SELECT DISTINCT page, href AS entity FROM links), df AS (SELECT entity, count(*) AS df FROM ent GROUP BY entity),
targets AS (SELECT page_id AS target FROM pages),
pts AS (SELECT t.target, b.page, 20 AS points FROM targets t JOIN branch a ON a.page = t.target JOIN branch b ON lower(a.branch) = lower(b.branch)
  UNION ALL SELECT t.target, e2.page, greatest(5, 60 // df)::INT FROM targets t JOIN ent e1 ON e1.page = t.target JOIN ent e2 USING (entity) JOIN df USING (entity)
  UNION ALL SELECT target, target + 1, 100 FROM targets WHERE target + 1 IN (SELECT page_id FROM pages)
  UNION ALL SELECT target, target - 1, 80 FROM targets WHERE target - 1 IN (SELECT page_id FROM pages)),
s AS (SELECT target, page, sum(points)::BIGINT AS score FROM pts WHERE page <> target GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, page)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5"""


@query(RELATED_SQL)
def related_pages_topk(t):
    pages = t.pages.select(F.col("page_id").alias("page"), F.regexp_extract("url", "://([^/]*)", 1).alias("branch"))
    ents = t.pages.select(F.col("page_id").alias("page"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("entity"))
    links = t.pages.select(F.col("page_id").alias("page"), (F.col("page_id") + 1).alias("to_page"))
    targets = t.pages.select(F.col("page_id").alias("target"))
    return related.related_pages(pages, links, ents, targets, 5)


@query(f"WITH {LINKS_SQL} SELECT href AS entity, count(DISTINCT page) AS df FROM links GROUP BY href")
def entity_df(t):
    ents = t.pages.select(F.col("page_id").alias("page"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("entity"))
    return related.document_frequency(ents)


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), '/de/') OR page_id IN (1, 2, 3) ")
def catalog_selection(t):
    nodes = t.pages.select("page_id", "url", F.lit("page").alias("title"), F.array(F.lit("docs")).alias("breadcrumb"))
    asked = t.pages.where("page_id in (1, 2, 3)").select("url")
    return related.select_catalog(nodes, ["docs"], ["/de/"], asked).select("page_id", "url")


@query("""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\n+', '') AS x FROM documents) SELECT doc_id, sha256(regexp_replace(x, '\\n+$', '')) AS digest FROM n""")
def excerpt_digest(t):
    return t.documents.select("doc_id", F.sha2(text.trim_excerpt(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, 'frag-' || substr(sha256(text), 1, 24) AS fragment_id, 'obs-' || substr(sha256(text), 1, 20) AS observation_id FROM documents")
def stable_ids(t):
    from attestor.functions.identity import stable_id

    return t.documents.select("doc_id", stable_id("frag", F.col("text")).alias("fragment_id"), stable_id("obs", F.col("text"), 20).alias("observation_id"))


FRESHNESS_SQL = """WITH b AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'openapi' ELSE 'page' END AS kind, CASE WHEN doc_id % 6 = 0 THEN 'v1' END AS version, sha256(text) AS h, source FROM documents),
o AS (SELECT doc_id AS id, doc_id % 13 = 0 AS failed, CASE WHEN doc_id % 11 = 0 THEN 304 ELSE 200 END AS st, CASE WHEN doc_id % 12 = 0 THEN 'v2' WHEN doc_id % 6 = 0 THEN 'v1' END AS v1, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h1 FROM documents WHERE doc_id % 17 <> 0),
c AS (SELECT b.*, o.failed, st, v1, h1, (kind = 'openapi' AND version IS NOT NULL AND v1 IS NOT NULL) AS vs FROM b LEFT JOIN o USING (id)),
s AS (SELECT *, CASE WHEN coalesce(failed, true) THEN 'fetch_failed' WHEN st = 304 THEN 'unchanged' WHEN v1 IS NULL AND h1 IS NULL THEN 'fetch_failed' WHEN vs THEN (CASE WHEN version = v1 THEN 'unchanged' ELSE 'changed' END) WHEN h1 IS NULL THEN 'fetch_failed' WHEN h = h1 THEN 'unchanged' ELSE 'changed' END AS status FROM c)
SELECT id, status, CASE WHEN status = 'changed' THEN (CASE WHEN vs THEN 'version' ELSE 'sha256' END) END AS reason FROM s"""


@query(FRESHNESS_SQL)
def freshness_classify(t):
    return _freshness(t)


def _freshness(t: Tables) -> DataFrame:
    d = t.documents
    base = d.select(F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'openapi' ELSE 'page' END").alias("kind"), F.expr("CASE WHEN doc_id % 6 = 0 THEN 'v1' END").alias("version"), F.sha2("text", 256).alias("sha256"))
    seen = d.where("doc_id % 17 != 0").select(
        F.col("doc_id").alias("id"), F.expr("doc_id % 13 = 0").alias("failed"), F.expr("CASE WHEN doc_id % 11 = 0 THEN 304 ELSE 200 END").alias("http_status"), F.expr("CASE WHEN doc_id % 12 = 0 THEN 'v2' WHEN doc_id % 6 = 0 THEN 'v1' END").alias("version"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN sha2(concat(text, 'x'), 256) ELSE sha2(text, 256) END").alias("sha256"),
    )
    return compare.freshness(base, seen)


@query("""WITH f AS (SELECT source, CASE WHEN bool_or(toxic = 1) THEN 'changed' WHEN bool_or(quality = 0) THEN 'inconclusive' ELSE 'unchanged' END AS verdict, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, n, verdict FROM f""")
def freshness_verdict(t):
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").withColumn("status", F.expr("CASE WHEN toxic = 1 THEN 'changed' WHEN quality = 0 THEN 'fetch_failed' ELSE 'unchanged' END"))
    return compare.freshness_verdict(rows, ["source"])


@query(f"SELECT id, status, CASE status WHEN 'changed' THEN 're_extract' ELSE 'check_source' END AS action FROM ({FRESHNESS_SQL}) WHERE status <> 'unchanged'")
def governance_triggers(t):
    return compare.governance_triggers(_freshness(t))


ISSUES_SQL = """issues AS (SELECT doc_id, source, CASE WHEN quality = 0 AND toxic = 1 THEN 'SOURCE_CONFLICT' WHEN quality = 0 THEN 'REQUIRED_INFO_MISSING' WHEN doc_id % 5 = 0 THEN 'OUTPUT_MISMATCH' ELSE 'SOURCE_UNVERIFIED' END AS code,
CASE WHEN quality = 0 THEN 'error' ELSE 'warning' END AS severity FROM labels JOIN documents USING (doc_id) WHERE quality = 0 OR toxic = 1 OR doc_id % 40 = 0)"""
SCORES_SQL = f"""{ISSUES_SQL}, p AS (SELECT *, CASE WHEN severity = 'warning' THEN 12 WHEN code = 'SOURCE_CONFLICT' THEN 50 ELSE 40 END AS pen, CASE code WHEN 'REQUIRED_INFO_MISSING' THEN 'completeness' WHEN 'OUTPUT_MISMATCH' THEN 'consistency' ELSE 'source_grounding' END AS cat FROM issues),
s AS (SELECT doc_id // 20 AS run, 100 AS openapi_validity, greatest(0, 100 - coalesce(sum(pen) FILTER (WHERE cat = 'completeness'), 0))::INT AS completeness, greatest(0, 100 - coalesce(sum(pen) FILTER (WHERE cat = 'consistency'), 0))::INT AS consistency, greatest(0, 100 - coalesce(sum(pen) FILTER (WHERE cat = 'source_grounding'), 0))::INT AS source_grounding, 100 AS reviewability, bool_or(severity = 'error') AS blocking, count(*) AS n_findings FROM p GROUP BY 1),
tot AS (SELECT *, round_even((openapi_validity * 20 + completeness * 30 + consistency * 20 + source_grounding * 20 + reviewability * 10) / 100.0, 0)::INT AS total FROM s)"""


def _issues(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").where("quality = 0 or toxic = 1 or doc_id % 40 = 0")
    code = F.expr("CASE WHEN quality = 0 AND toxic = 1 THEN 'SOURCE_CONFLICT' WHEN quality = 0 THEN 'REQUIRED_INFO_MISSING' WHEN doc_id % 5 = 0 THEN 'OUTPUT_MISMATCH' ELSE 'SOURCE_UNVERIFIED' END")
    return rows.select("doc_id", "source", F.expr("doc_id div 20").alias("run"), code.alias("code"), F.expr("CASE WHEN quality = 0 THEN 'error' ELSE 'warning' END").alias("severity"))


@query(f"WITH {SCORES_SQL} SELECT run, openapi_validity, completeness, consistency, source_grounding, reviewability, total, blocking, n_findings, CASE WHEN blocking THEN 'fail' WHEN total < 85 THEN 'fail' ELSE 'needs_attention' END AS status FROM tot")
def category_score_weighted(t):
    return scoring.evaluate(_issues(t), ["run"])


@query(f"""WITH {SCORES_SQL}, v AS (SELECT run, total, lag(total) OVER (ORDER BY run) AS prev FROM tot)
SELECT run, total, prev, CASE WHEN total >= 95 THEN 'converged' WHEN run % 4 + 1 >= 4 THEN 'exhausted' WHEN prev IS NOT NULL AND total <= prev THEN 'plateau' ELSE 'continue' END AS verdict FROM v""")
def loop_verdict(t):
    numbered = manifest.row_numbers(scoring.evaluate(_issues(t), ["run"]).select("run", "total"), ["run"], "n")
    totals = numbered.join(numbered.select((F.col("n") + 1).alias("n"), F.col("total").alias("prev")), "n", "left")
    verdict = scoring.loop_verdict(F.col("prev"), F.col("total"), F.lit(95), F.col("run") % 4 + 1, F.lit(4), F.lit(1))
    return totals.select("run", "total", "prev", verdict.alias("verdict"))


@query(f"WITH {ISSUES_SQL} SELECT code, severity, source AS target_file, min(doc_id) AS first_ord, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS locations FROM issues GROUP BY ALL HAVING count(*) > 1")
def root_cause_groups(t):
    return scoring.root_causes(_issues(t).select("code", "severity", F.col("source").alias("target_file"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("location")))


@query(f"WITH {ISSUES_SQL} SELECT source AS target, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM issues WHERE severity = 'error' GROUP BY source")
def correction_requests(t):
    none = F.lit(None).cast("string")
    return scoring.corrections(_issues(t).select("code", "severity", none.alias("root_cause"), none.alias("claim"), F.col("source").alias("location")))


@query(f"WITH {ISSUES_SQL} SELECT source, code, CASE max(CASE severity WHEN 'error' THEN 2 ELSE 1 END) WHEN 2 THEN 'blocked' ELSE 'needs_attention' END AS status, count(*) AS n FROM issues GROUP BY ROLLUP (source, code)")
def preparation_rollup(t):
    return scoring.phase_status(_issues(t), ["source", "code"])


@query("""WITH e AS (SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1), o AS (SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE n_chars > 400),
m AS (SELECT coalesce(e.lang, o.lang) AS lang, count(e.doc_id) AS ne, count(o.doc_id) AS no, count(CASE WHEN e.doc_id IS NOT NULL AND o.doc_id IS NOT NULL THEN 1 END) AS b FROM e FULL JOIN o ON e.lang = o.lang AND e.doc_id = o.doc_id GROUP BY 1)
SELECT lang, ne AS n_expected, no AS n_observed, CASE WHEN no = 0 THEN (CASE WHEN ne = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ELSE b::DOUBLE / no END AS precision, CASE WHEN ne = 0 THEN 1.0::DOUBLE ELSE b::DOUBLE / ne END AS recall,
1 - (CASE WHEN no = 0 THEN (CASE WHEN ne = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ELSE b::DOUBLE / no END) AS unsupported, 1 - (CASE WHEN ne = 0 THEN 1.0::DOUBLE ELSE b::DOUBLE / ne END) AS omission, CASE WHEN ne + no - b = 0 THEN 1.0::DOUBLE ELSE b::DOUBLE / (ne + no - b) END AS accuracy FROM m""")
def metric_precision_recall(t):
    from attestor.operators.claims import claim_metrics

    rows = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return claim_metrics(rows.where("quality = 1"), rows.where("n_chars > 400"), ["doc_id"], ["lang"])
