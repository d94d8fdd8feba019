"""Queries over evidence: fragments by locator, signatures of examples, snapshots under review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators import evidence, governance, signing
from attestor.plans.registry import query


def _guides(t) -> DataFrame:
    """All documents inside a frame of headings and page markers."""
    text = F.concat(F.lit("# Doc\n## Part\nnumber "), "doc_id", F.lit("\n## Text\n<!-- page: 1 -->\n"), "text", F.lit("\n<!-- page: 2 -->\nlast "), "lang", F.lit("\n"))
    return t.documents.select(F.col("doc_id").cast("string").alias("source"), text.alias("text"))


_GUIDE_SQL = r"""d AS (SELECT doc_id, doc_id::VARCHAR AS source, text AS body, lang, concat('# Doc', chr(10), '## Part', chr(10), 'number ', doc_id, chr(10), '## Text', chr(10), '<!-- page: 1 -->', chr(10), text, chr(10), '<!-- page: 2 -->', chr(10), 'last ', lang, chr(10)) AS text FROM documents),
told AS (SELECT d.*, raw, kind, CASE raw WHEN 'd lines 1-3' THEN '# Doc' || chr(10) || '## Part' || chr(10) || 'number ' || doc_id WHEN 'd lines 5-6' THEN '<!-- page: 1 -->' || chr(10) || string_split(body, chr(10))[1] WHEN 'd p.1' THEN body WHEN 'd Page 2' THEN 'last ' || lang WHEN 'section:Doc > Part' THEN '## Part' || chr(10) || 'number ' || doc_id END AS said
  FROM d, (VALUES ('d lines 1-3', 'lines'), ('d lines 5-6', 'lines'), ('d lines 2-99999999', 'lines'), ('d p.1', 'page'), ('d Page 2', 'page'), ('d p.3', 'page'), ('section:Doc > Part', 'section'), ('css:#a', 'css')) v(raw, kind)),
f AS (SELECT source, raw, kind, text, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(said), '[ \t]+(\n|$)', '\1', 'g'), '^\n+', ''), '\n+$', '') AS excerpt FROM told)"""
_RAWS = ["d lines 1-3", "d lines 5-6", "d lines 2-99999999", "d p.1", "d Page 2", "d p.3", "section:Doc > Part", "css:#a"]


@query(f"WITH {_GUIDE_SQL} SELECT source, raw, kind, CASE WHEN excerpt IS NULL THEN 'unresolved' WHEN kind = 'section' THEN 'section' ELSE 'exact' END AS precision, length(excerpt)::INT AS n_chars, sha256(coalesce(excerpt, text)) AS digest FROM f")
def document_fragments(t):
    """Eight locators of every document: lines, pages, a heading path, a selector; some lead nowhere."""
    docs = _guides(t)
    asked = docs.select("source", F.explode(F.array(*map(F.lit, _RAWS))).alias("raw"))
    return evidence.acquire_fragments(docs, asked, sections=True).select("source", "raw", "kind", "precision", F.length("excerpt").alias("n_chars"), "digest")


@query(f"WITH {_GUIDE_SQL}, g AS (SELECT *, sha256(CASE WHEN source::BIGINT % 7 = 0 THEN 'other' ELSE coalesce(excerpt, text) END) AS declared FROM f) SELECT source, raw, CASE WHEN excerpt IS NULL THEN 'unresolved' ELSE 'digest_mismatch' END AS reason FROM g WHERE excerpt IS NULL OR source::BIGINT % 7 = 0")
def refuted_references(t):
    """References of every document that declare what acquisition found, except that a seventh of the documents were others then."""
    docs = _guides(t)
    asked = docs.select("source", F.explode(F.array(*map(F.lit, _RAWS))).alias("raw"))
    other = F.when(F.col("source").cast("long") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("digest"))
    declared = evidence.acquire_fragments(docs, asked, sections=True).select("source", "raw", other.alias("digest"))
    return evidence.refuted_references(declared, docs, sections=True).select("source", "raw", "reason")


@query("""WITH e AS (SELECT event_id::VARCHAR AS source, props, raw FROM events, (VALUES ('e.json#'), ('e.json#/k'), ('e.json#/none')) v(raw)),
f AS (SELECT source, raw, props, CASE raw WHEN 'e.json#' THEN json(props)::VARCHAR WHEN 'e.json#/k' THEN json_extract(props, '$.k')::VARCHAR END AS excerpt FROM e)
SELECT source, raw, CASE WHEN excerpt IS NULL THEN 'unresolved' ELSE 'exact' END AS precision, excerpt, sha256(coalesce(excerpt, props)) AS digest FROM f""")
def event_pointers(t):
    """The properties of every event by JSON pointer: whole, one member, a member that is not there."""
    docs = t.events.select(F.col("event_id").cast("string").alias("source"), F.col("props").alias("text"))
    asked = docs.select("source", F.explode(F.array(*map(F.lit, ["e.json#", "e.json#/k", "e.json#/none"]))).alias("raw"))
    return evidence.acquire_fragments(docs, asked).select("source", "raw", "precision", "excerpt", "digest")


@query("""WITH n AS (SELECT doc_id AS run, text || CASE doc_id % 5 WHEN 0 THEN ' 用 AES 加密' WHEN 1 THEN ' HashIV, SHA256' WHEN 2 THEN ' sha256' ELSE '' END AS text FROM documents),
w AS (SELECT run, CASE WHEN contains(text, '加密') THEN '加密' WHEN contains(text, '簽章') THEN '簽章' WHEN contains(text, 'AES') THEN 'AES' WHEN contains(text, 'HashKey') THEN 'HashKey' WHEN contains(text, 'HashIV') THEN 'HashIV' WHEN contains(text, 'SHA256') THEN 'SHA256' END AS word FROM n)
SELECT run, word FROM w WHERE word IS NOT NULL AND run NOT IN (SELECT doc_id FROM labels)""")
def signal_gaps(t):
    """Documents that speak of signatures, of which those with labels have a mechanism."""
    more = F.expr("CASE doc_id % 5 WHEN 0 THEN ' 用 AES 加密' WHEN 1 THEN ' HashIV, SHA256' WHEN 2 THEN ' sha256' ELSE '' END")
    return signing.signal_gaps(t.documents.select(F.col("doc_id").alias("run"), F.concat("text", more).alias("text")), t.labels.select(F.col("doc_id").alias("run")))


@query("""WITH s AS (SELECT p_partkey AS run, '0' AS label, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'sig' END AS field FROM part WHERE p_size % 3 <> 0 AND p_size % 2 = 0 AND p_size % 5 > 0
  UNION ALL SELECT p_partkey, p_brand, 'sign.' || p_size % 3 FROM part WHERE p_size % 2 = 1),
x AS (SELECT l_partkey AS run, l_orderkey || '/' || l_linenumber || '/request.' || CASE l_returnflag WHEN 'R' THEN 'sh' WHEN 'A' THEN 'py' ELSE 'ts' END AS path, l_returnflag <> 'R' AS code, l_linenumber % 3 AS form, 'sign.' || l_suppkey % 3 AS other FROM lineitem)
SELECT run, label, 'integration.crypto.' || label AS location, 'REQUIRED_INFO_MISSING' AS code FROM s WHERE field IS NULL
UNION ALL SELECT run, label, path, 'OUTPUT_MISMATCH' FROM s JOIN x USING (run) WHERE x.code AND (field = 'sig' AND form = 0 OR field = other AND form = 1)""")
def signature_findings(t):
    """Two mechanisms of every part and an example for each of its lines."""
    size = F.col("p_size")
    one = t.part.select(
        F.col("p_partkey").alias("run"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("name"), F.when(size % 3 == 0, "response").when(size % 3 == 1, "request").alias("purpose"), F.when(size % 2 == 0, "AES-256-CBC").otherwise("DES").alias("algorithm"), F.lit("").alias("mode"), (size % 5).alias("steps"), F.when(size % 4 != 0, "sig").alias("field"),
    )
    two = t.part.select("p_partkey", F.lit(1), "p_brand", F.lit("signature"), F.lit("aes"), F.when(size % 2 == 1, "cbc").otherwise("GCM"), F.lit(2), F.concat(F.lit("sign."), (size % 3).cast("string")))
    form = F.col("l_linenumber") % 3
    name = F.concat(F.lit("sign."), (F.col("l_suppkey") % 3).cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "sh").when(F.col("l_returnflag") == "A", "py").otherwise("ts")
    content = F.when(form == 0, "# sig\nbody = {'sig': 1, \"x\": 2}").when(form == 1, F.concat(F.lit('{"'), name, F.lit('" : 1}; body["sig"] = sign(x)'))).otherwise(F.concat(F.lit('"sig": 1, "'), name, F.lit("\": 2\nbody['sig'] = sign_a(x)\nbody[\""), name, F.lit('"] = sign(y)')))
    examples = t.lineitem.select(F.col("l_partkey").alias("run"), F.concat_ws("", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit("request.")), kind).alias("path"), content.alias("content"))
    return signing.signature_findings(one.unionAll(two), examples)


def _scan(t) -> DataFrame:
    said: Column = F.when(F.col("doc_id") % 11 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256))
    return t.documents.select(F.expr("doc_id div 10").cast("string").alias("label"), F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 == 0, "changed").otherwise("unchanged").alias("status"), said.alias("sha256"), F.encode("text", "utf-8").alias("raw"))


_LEDGER_SQL = """l AS (SELECT (doc_id // 10)::VARCHAR AS label, doc_id::VARCHAR AS id, sha256(text) AS sha, 'sources/' || sha256(text) || '.source' AS path FROM documents WHERE doc_id % 3 = 0 AND doc_id % 11 <> 0 AND text IS NOT NULL),
s AS (SELECT *, CASE left(sha, 1) WHEN '0' THEN 'missing' WHEN '1' THEN 'digest_mismatch' ELSE 'verified' END AS state FROM l)"""


def _snapshot(t) -> tuple[DataFrame, DataFrame]:
    """The ledger of a scan, and its files, some of which were lost, changed or added since."""
    ledger = governance.snapshot_sources(_scan(t)).where("error is null").select("label", "id", "sha256", "path")
    start = F.substring("sha256", 1, 1)
    kept = ledger.where(start != "0").select("path", F.when(start == "1", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return ledger, kept.unionAll(t.supplier.select(F.concat(F.lit("more/"), "s_suppkey"), F.lit("x")))


@query(f"WITH {_LEDGER_SQL} SELECT DISTINCT path, state FROM s UNION ALL SELECT 'more/' || s_suppkey, 'unlisted' FROM supplier")
def snapshot_files(t):
    return governance.verify_files(*_snapshot(t)).select("path", "state")


@query(f"""WITH {_LEDGER_SQL}, g AS (SELECT label, count(DISTINCT id) AS n, min(CASE WHEN state <> 'verified' THEN state || ': ' || path END) AS bad FROM s GROUP BY label),
k AS (SELECT DISTINCT doc_id // 10 AS number FROM documents), m AS (SELECT number::VARCHAR AS label, CASE WHEN number % 4 = 0 THEN 'freshness_inconclusive' ELSE 'source_changed' END AS kind, coalesce(n, 0)::INT AS n_sources, coalesce(bad, CASE WHEN number % 4 <> 0 AND n IS NULL THEN 'no verified snapshot' END) AS error FROM k LEFT JOIN g ON g.label = number::VARCHAR)
SELECT label, kind, n_sources, CASE WHEN error IS NULL THEN CASE kind WHEN 'source_changed' THEN 3 ELSE 2 END END::INT AS n_steps, error FROM m""")
def review_plan(t):
    """A trigger for every ten documents, with what the snapshot holds of them."""
    ledger, files = _snapshot(t)
    number = F.expr("doc_id div 10")
    triggers = t.documents.select(number.alias("number")).distinct().select(F.col("number").cast("string").alias("label"), F.when(F.col("number") % 4 == 0, "freshness_inconclusive").otherwise("source_changed").alias("kind"), F.lit(None).cast("string").alias("reason"))
    plan = governance.review_plan(triggers, ledger, files)
    return plan.select("label", "kind", F.size("sources").alias("n_sources"), F.when(F.col("error").isNull(), F.size("steps")).alias("n_steps"), "error")
