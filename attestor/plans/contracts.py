"""Queries over the order tables and events, which stand in for operations, claims, references and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import identity, json_text, text
from attestor.operators import claims, compare, conformance, facts, lifecycle, related, risk, scoring, validators
from attestor.operators.manifest import occurrence_keys, sequential_ids
from attestor.plans.registry import Tables, query


def _states(t: Tables) -> tuple[DataFrame, DataFrame]:
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    base = t.orders.where("o_orderkey % 10 != 3").select(*cols)
    head = t.orders.where("o_orderkey % 10 != 7").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE o_orderstatus END").alias("o_orderstatus"), "o_orderpriority")
    return base, head


DIFF_SQL = """b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 3), h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 7),
d AS (SELECT coalesce(b.o_orderkey, h.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN h.o_orderkey IS NULL THEN 'removed' WHEN b.o_orderstatus <> h.o_orderstatus THEN 'changed' END AS change FROM b FULL JOIN h ON b.o_orderkey = h.o_orderkey)"""


@query(f"WITH {DIFF_SQL} SELECT o_orderkey, change, CASE WHEN change = 'changed' THEN 'o_orderstatus' ELSE '' END AS fields FROM d WHERE change IS NOT NULL")
def diff_added_removed_changed(t):
    return compare.keyed_diff(*_states(t), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(f"WITH {DIFF_SQL}, f AS (SELECT CASE change WHEN 'added' THEN 'additive' WHEN 'removed' THEN 'breaking' ELSE 'changed' END AS impact FROM d WHERE change IS NOT NULL) SELECT i AS impact, count(f.impact) AS n FROM (VALUES ('breaking'), ('changed'), ('additive'), ('source_only')) v(i) LEFT JOIN f ON f.impact = v.i GROUP BY i")
def diff_summary_pivot(t):
    found = compare.keyed_diff(*_states(t), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return compare.impact_summary(found.select(F.expr("CASE change WHEN 'added' THEN 'additive' WHEN 'removed' THEN 'breaking' ELSE 'changed' END").alias("impact")))


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def set_union(t):
    return t.customer.select(F.col("c_custkey").alias("k")).union(t.orders.select("o_custkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(t):
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def set_symdiff(t):
    part = t.lineitem.select(F.col("l_partkey").alias("k"), "l_returnflag")
    return compare.symmetric_difference(part.where("l_returnflag = 'R'"), part.where("l_returnflag = 'A'"), ["k"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def dangling_references(t):
    return validators.dangling(t.lineitem, "l_partkey", t.part.where("p_size > 3"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH f AS (SELECT p_partkey AS part, p_brand AS name FROM part), e AS (SELECT l_partkey AS part, 'Brand.' || lower(p_brand) AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 AND p_size % 3 = 0 UNION ALL SELECT l_partkey, 'other' FROM lineitem WHERE l_linenumber = 1)
SELECT f.part, f.name FROM f WHERE part IN (SELECT part FROM e) AND NOT EXISTS (SELECT 1 FROM e WHERE e.part = f.part AND (lower(e.name) = lower(f.name) OR lower(regexp_extract(e.name, '([^.]*)$', 1)) = lower(f.name)))""")
def semi_fact_gate(t):
    known = t.part.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("name"))
    lines = t.lineitem.where("l_linenumber = 1").select(F.col("l_partkey").alias("part"))
    brand = lines.join(t.part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("part"), F.concat(F.lit("Brand."), F.lower("p_brand")).alias("name")), "part")
    return validators.missing_names(known, brand.unionByName(lines.withColumn("name", F.lit("other"))), ["part"], "name")


CLAIMS_SQL = """p AS (SELECT l_partkey AS identity, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linestatus = 'F' AND l_tax > 0.05 THEN NULL ELSE l_returnflag END AS value, l_quantity > 45 AS supported, l_discount >= 0.1 AND l_quantity > 49 AS contradicted FROM lineitem)"""
RECONCILE_SQL = f"""{CLAIMS_SQL}, g AS (SELECT identity, bool_or(contradicted) AS against, list_sort(list_distinct(list(value) FILTER (WHERE supported AND NOT contradicted AND value IS NOT NULL))) AS vals, bool_and(value IS NULL) AS empty, arg_min_null(value, id) AS lowest, count(*) AS n_proposals FROM p GROUP BY identity),
s AS (SELECT *, coalesce(len(vals), 0) AS n, CASE WHEN against THEN 'conflicting' WHEN len(vals) = 1 THEN 'supported' WHEN len(vals) > 1 THEN 'conflicting' WHEN empty THEN 'missing' ELSE 'unverified' END AS status FROM g)"""


@query(f"WITH {RECONCILE_SQL} SELECT identity, status, CASE WHEN status IN ('supported', 'conflicting') THEN (CASE WHEN n > 0 THEN array_to_string(vals, '|') END) WHEN status = 'unverified' THEN lowest END AS value, n_proposals FROM s")
def reconcile_status(t):
    rows = t.lineitem.select(
        F.col("l_partkey").alias("identity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.expr("CASE WHEN l_linestatus = 'F' AND l_tax > 0.05 THEN NULL ELSE l_returnflag END").alias("value"), F.expr("l_quantity > 45").alias("supported"), F.expr("l_discount >= 0.1 AND l_quantity > 49").alias("contradicted"),
    )
    return claims.reconcile(rows)


@query("SELECT DISTINCT o_custkey AS identity, 'superseded' AS status FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def superseded_identities(t):
    return claims.superseded(t.orders.select(F.col("o_custkey").alias("identity")).distinct(), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("identity")))


SUPPORT_SQL = """f AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'section' ELSE 'exact' END AS prec, p_size % 11 <> 0 AS mat, p_name AS excerpt, CASE WHEN p_size % 13 = 0 THEN 'bad' ELSE sha256(p_name) END AS digest, p_brand AS value, CASE WHEN p_size % 2 = 0 THEN 'cell' END AS role FROM part WHERE p_partkey % 9 <> 0),
s AS (SELECT l_orderkey * 10 + l_linenumber AS support_id, l_partkey AS fragment_id, CASE WHEN l_quantity > 25 THEN p_brand ELSE p_name END AS claim_value, l_linenumber <> 6 AS path_known FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT support_id, CASE WHEN f.id IS NULL THEN 'FRAGMENT_NOT_FOUND' WHEN prec <> 'exact' THEN 'FRAGMENT_NOT_EXACT' WHEN NOT mat THEN 'FRAGMENT_NOT_MATERIALIZED' WHEN sha256(excerpt) <> digest THEN 'FRAGMENT_DIGEST_MISMATCH' WHEN NOT path_known THEN 'CLAIM_PATH_UNKNOWN' WHEN (CASE WHEN role IS NOT NULL THEN value ELSE excerpt END) = claim_value THEN NULL WHEN role IS NOT NULL THEN 'EVIDENCE_VALUE_MISMATCH' ELSE 'FRAGMENT_NOT_VALUE_BEARING' END AS reason_code FROM s LEFT JOIN f ON f.id = s.fragment_id)"""


@query(f"WITH {SUPPORT_SQL} SELECT support_id, reason_code, CASE WHEN reason_code IS NULL THEN 'direct_support' WHEN reason_code = 'EVIDENCE_VALUE_MISMATCH' THEN 'contradicts' ELSE 'insufficient' END AS relationship FROM r")
def verification_ladder(t):
    frag = t.part.where("p_partkey % 9 != 0").select(
        F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_size % 7 = 0 THEN 'section' ELSE 'exact' END").alias("precision"), F.expr("p_size % 11 != 0").alias("materialised"), F.col("p_name").alias("excerpt"), F.expr("CASE WHEN p_size % 13 = 0 THEN 'bad' ELSE sha2(p_name, 256) END").alias("digest"), F.col("p_brand").alias("value"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'cell' END").alias("role"),
    )
    lines = t.lineitem.join(t.part.select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    support = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("support_id"), F.col("l_partkey").alias("fragment_id"), F.expr("CASE WHEN l_quantity > 25 THEN p_brand ELSE p_name END").alias("claim_value"), F.expr("l_linenumber != 6").alias("path_known"), F.lit("direct_support").alias("proposed"))
    return claims.verify_support(support, frag).select("support_id", "relationship", "reason_code")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def ordered_first_merge(t):
    return claims.first_wins(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("WITH f AS (SELECT l_suppkey, l_shipmode, min(l_orderkey) AS ord FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode, l_orderkey FROM lineitem) GROUP BY ALL) SELECT l_suppkey, string_agg(l_shipmode, ',' ORDER BY ord, l_shipmode) AS vals FROM f GROUP BY l_suppkey")
def first_seen_distinct(t):
    rows = t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("v"), "l_orderkey")
    return claims.ordered_union(rows, ["l_suppkey"], "v", "l_orderkey").select("l_suppkey", F.array_join("values", ",").alias("vals"))


@query("WITH u AS (SELECT event_type, count(DISTINCT day) AS units FROM (SELECT event_type, date_trunc('day', ts) AS day FROM events) GROUP BY 1), h AS (SELECT event_type, user_id % 50 AS bucket, count(DISTINCT date_trunc('day', ts)) AS n FROM events GROUP BY 1, 2) SELECT event_type, bucket FROM h JOIN u USING (event_type) WHERE n = units")
def fact_intersection(t):
    rows = t.events.select("event_type", (F.col("user_id") % 50).alias("bucket"), F.date_trunc("day", "ts").alias("day"))
    return claims.intersect_lists(rows, ["event_type"], "bucket", "day")


@query("SELECT event_type AS code, count(*) AS n_facts, count(DISTINCT user_id) AS n_sources, min(event_id) AS first_event FROM events GROUP BY event_type")
def floor_union(t):
    return facts.error_code_floor(t.events.select(F.col("event_type").alias("code"), F.col("user_id").alias("source"), F.col("event_id").alias("ord"))).withColumnRenamed("first_ord", "first_event")


@query("WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), m AS (SELECT coalesce(a.k, b.k) AS l_partkey, coalesce(a.n, 0) AS n_expected, coalesce(b.n, 0) AS n_actual FROM a FULL JOIN b ON a.k = b.k) SELECT * FROM m WHERE n_expected <> n_actual OR n_actual > 1")
def count_violations(t):
    return scoring.repeated_identities(t.lineitem.where("l_returnflag = 'A'"), t.lineitem.where("l_returnflag = 'R'"), "l_partkey")


OBS_SQL = """c AS (SELECT p_partkey AS claim, '/value' AS path, p_brand AS expected, p_type FROM part),
o AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS claim, '/value' AS path, CASE WHEN l_linenumber = 1 THEN 'response_field' WHEN l_linenumber = 2 THEN 'operation_success' ELSE 'value' END AS kind, CASE WHEN l_linenumber = 5 THEN 'contract_derived' WHEN l_linenumber = 4 THEN 'manual' ELSE 'recorded' END AS lineage, l_linestatus = 'O' OR l_tax < 0.07 AS in_scope, CASE WHEN l_discount > 0.08 THEN 'timeout' ELSE 'api_response' END AS outcome,
 CASE WHEN l_linenumber <= 2 THEN (CASE WHEN l_quantity > 10 THEN 'true' ELSE 'false' END) WHEN l_quantity > 20 THEN p_brand ELSE 'other' END AS observed FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT o.*, expected, p_type, CASE WHEN NOT in_scope THEN 'out_of_scope' WHEN outcome <> 'api_response' THEN 'inconclusive' WHEN lineage = 'contract_derived' AND observed = expected THEN 'inconclusive' WHEN lineage = 'manual' THEN 'inconclusive' WHEN (CASE kind WHEN 'response_field' THEN observed IN ('true', 'present') WHEN 'operation_success' THEN observed = 'true' ELSE observed = expected END) THEN 'confirms' ELSE 'contradicts' END AS relationship FROM o JOIN c USING (claim, path))"""


def _claims(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("claim"), F.lit("/value").alias("path"), F.col("p_brand").alias("expected"))


def _related(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    obs = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("claim"), F.lit("/value").alias("path"),
        F.expr("CASE WHEN l_linenumber = 1 THEN 'response_field' WHEN l_linenumber = 2 THEN 'operation_success' ELSE 'value' END").alias("kind"),
        F.expr("CASE WHEN l_linenumber = 5 THEN 'contract_derived' WHEN l_linenumber = 4 THEN 'manual' ELSE 'recorded' END").alias("lineage"), F.expr("l_linestatus = 'O' OR l_tax < 0.07").alias("in_scope"),
        F.expr("CASE WHEN l_discount > 0.08 THEN 'timeout' ELSE 'api_response' END").alias("outcome"),
        F.expr("CASE WHEN l_linenumber <= 2 THEN (CASE WHEN l_quantity > 10 THEN 'true' ELSE 'false' END) WHEN l_quantity > 20 THEN p_brand ELSE 'other' END").alias("observed"), F.lit(1).alias("n_outcomes"),
    )
    return conformance.relationships(obs, _claims(t))


@query(f"WITH {OBS_SQL} SELECT id, claim, kind, relationship FROM r")
def conformance_relationships(t):
    return _related(t).select("id", "claim", "kind", "relationship")


@query(f"WITH {OBS_SQL}, per AS (SELECT claim, path, bool_or(relationship IN ('confirms', 'contradicts')) AS assessed, bool_or(relationship = 'confirms') AS confirmed FROM r GROUP BY ALL), g AS (SELECT p_type, count(*) AS n_paths, count(*) FILTER (WHERE assessed) AS n_assessed, count(*) FILTER (WHERE confirmed) AS n_confirmed FROM c LEFT JOIN per USING (claim, path) GROUP BY p_type) SELECT *, n_assessed::DOUBLE / n_paths AS assessed, n_confirmed::DOUBLE / n_paths AS confirmed FROM g")
def conformance_coverage(t):
    known = t.part.select(F.col("p_partkey").alias("claim"), F.lit("/value").alias("path"), "p_type")
    return conformance.coverage(known, _related(t), ["p_type"])


@query(f"""WITH {OBS_SQL}, x AS (SELECT claim, relationship, kind IN ('operation_success', 'response_field') AS risk, CASE WHEN id % 4 = 0 THEN 'fixture' WHEN id % 4 = 1 THEN 'timeout' END AS cause, id % 3 AS att FROM r)
SELECT claim, count(*) AS n, CASE WHEN bool_or(relationship = 'contradicts') AND bool_and(CASE WHEN relationship = 'contradicts' THEN risk END) THEN 'provider_clarification' WHEN bool_or(relationship = 'contradicts') THEN 'amendment_proposal' WHEN bool_or(relationship = 'out_of_scope') THEN 'environment_configuration_correction' WHEN coalesce(bool_or(relationship = 'inconclusive' AND cause = 'fixture'), false) THEN 'implementation_correction'
WHEN coalesce(bool_or(relationship = 'inconclusive' AND cause = 'timeout' AND att >= 2), false) THEN 'provider_runtime_regression_review' WHEN bool_or(relationship = 'inconclusive') THEN 'needs_evidence' ELSE 'closed_no_change' END AS route FROM x GROUP BY claim""")
def feedback_route(t):
    rows = _related(t).select("claim", "relationship", F.col("kind").isin("operation_success", "response_field").alias("high_risk"), F.lit(True).alias("grounded"), F.expr("CASE WHEN id % 4 = 0 THEN 'fixture' WHEN id % 4 = 1 THEN 'timeout' END").alias("cause"), (F.col("id") % 3).alias("n_attempts"))
    return conformance.route(rows, ["claim"])


@query(f"WITH {OBS_SQL} SELECT claim, path, min(observed) AS proposed, count(*) AS n_refs FROM r WHERE relationship = 'contradicts' AND kind = 'value' GROUP BY ALL")
def feedback_proposals(t):
    rows = _related(t).withColumn("high_risk", F.col("kind") != "value")
    return conformance.proposals(rows).select("claim", "path", "proposed", "n_refs")


@query("""WITH a AS (SELECT p_partkey AS claim, 'amended' AS proposed, CASE WHEN p_size % 5 = 0 THEN TIMESTAMP '2030-01-01' ELSE TIMESTAMP '2020-01-01' END AS approved, CASE WHEN p_size % 3 = 0 THEN TIMESTAMP '2021-01-01' END AS expires FROM part WHERE p_size % 2 = 0),
l AS (SELECT * FROM a WHERE approved <= TIMESTAMP '2024-01-01' AND (expires IS NULL OR expires > TIMESTAMP '2024-01-01'))
SELECT p_partkey AS claim, p_brand AS expected, coalesce(proposed, p_brand) AS effective, proposed IS NOT NULL AS amended FROM part LEFT JOIN l ON l.claim = p_partkey""")
def effective_overlay(t):
    when = lambda s: F.lit(s).cast("timestamp_ntz")
    amend = t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("claim"), F.lit("/value").alias("path"), F.lit("amended").alias("proposed"), F.when(F.col("p_size") % 5 == 0, when("2030-01-01")).otherwise(when("2020-01-01")).alias("approved_at"), F.when(F.col("p_size") % 3 == 0, when("2021-01-01")).alias("expires_at"))
    return conformance.effective_values(_claims(t), amend, when("2024-01-01")).select("claim", "expected", "effective", "amended")


@query("""SELECT o_custkey, max_by(o_orderkey, row(o_orderdate, o_orderkey)) AS asset_id FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND (o_orderstatus = 'F' OR o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1997-01-01') GROUP BY o_custkey""")
def asof_validity(t):
    now = F.lit("1997-01-01").cast("timestamp_ntz")
    assets = t.orders.select("o_custkey", F.col("o_orderkey").alias("asset_id"), F.col("o_orderdate").alias("approved_at"), F.expr("CASE WHEN o_orderstatus != 'F' THEN o_orderdate + INTERVAL 365 DAY END").alias("valid_until"))
    return claims.latest_valid(assets, ["o_custkey"], now)


@query("""SELECT e.event_id, e.user_id, e.ts, v.value AS last_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_join(t):
    right = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return claims.asof_join(t.events.select("user_id", "ts", "event_id"), right, ["user_id"], "ts", "ts", ["last_value"])


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_partkey AS identity, l_returnflag AS location FROM lineitem), w AS (SELECT p_partkey AS identity, p_partkey * 2 + k AS waiver_id, CASE WHEN p_size % 3 = 0 THEN ['R', 'A'] ELSE [] END AS scope, CASE WHEN (p_size + k) % 4 = 0 THEN TIMESTAMP '2020-01-01' END AS expires FROM part, (VALUES (0), (1)) v(k) WHERE p_size % 5 = 0),
m AS (SELECT finding_id, min(waiver_id) AS waiver_id FROM f JOIN w USING (identity) WHERE (expires IS NULL OR expires > TIMESTAMP '2024-01-01') AND (len(scope) = 0 OR list_contains(scope, location)) GROUP BY 1)
SELECT f.finding_id, identity, location, waiver_id FROM f LEFT JOIN m USING (finding_id)""")
def waiver_join(t):
    found = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"), F.col("l_partkey").alias("identity"), F.col("l_returnflag").alias("location"))
    w = t.part.where("p_size % 5 = 0").select(F.col("p_partkey").alias("identity"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "p_size")
    waivers = w.select("identity", (F.col("identity") * 2 + F.col("k")).alias("waiver_id"), F.expr("CASE WHEN p_size % 3 = 0 THEN array('R', 'A') ELSE cast(array() AS array<string>) END").alias("scope"), F.expr("CASE WHEN (p_size + k) % 4 = 0 THEN TIMESTAMP_NTZ '2020-01-01' END").alias("expires_at"))
    return claims.waived(found, waivers, F.lit("2024-01-01").cast("timestamp_ntz")).select("finding_id", "identity", "location", "waiver_id")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'docs/' || n_name || '.md' WHEN 1 THEN 'docs/' || n_name || '.md' END AS source FROM orders JOIN nation ON n_nationkey = o_custkey % 25")
def pattern_join_bounded(t):
    names = t.nation.select(F.col("n_nationkey").alias("k"), "n_name")
    said = t.orders.join(names, F.col("o_custkey") % 25 == F.col("k")).select("o_orderkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('see docs/', n_name, '.md, line 4') WHEN 1 THEN concat(upper(n_name), '.MD') ELSE concat('x', n_name, '.mdx') END").alias("locator"))
    files = t.nation.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("docs/"), "n_name", F.lit(".md")).alias("path"))
    return related.match_sources(said, files, ["o_orderkey"]).select("o_orderkey", "source")


@query("""WITH RECURSIVE f AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 5 THEN n_nationkey - 2 WHEN n_nationkey = 0 THEN NULL WHEN n_nationkey = 8 THEN 99 ELSE (n_nationkey + 1) % 12 END AS parent FROM nation),
up(first, cur, depth) AS (SELECT id, parent, 1 FROM f WHERE parent IS NOT NULL UNION ALL SELECT u.first, c.parent, depth + 1 FROM up u JOIN f c ON c.id = u.cur WHERE c.parent IS NOT NULL AND u.cur <> u.first AND depth < 64)
SELECT DISTINCT first AS id, 'PARENT_CYCLE' AS violation FROM up WHERE cur = first UNION ALL SELECT id, 'PARENT_MISSING' FROM f WHERE parent NOT IN (SELECT id FROM f)""")
def parent_cycle_check(t):
    parent = F.expr("CASE WHEN n_nationkey % 6 = 5 THEN n_nationkey - 2 WHEN n_nationkey = 0 THEN NULL WHEN n_nationkey = 8 THEN 99 ELSE (n_nationkey + 1) % 12 END")
    found = claims.parent_cycles(t.nation.select(F.col("n_nationkey").alias("id"), parent.alias("parent")))
    return found.where("violation != 'PARENT_CYCLE' or on_cycle").select("id", "violation")


#: Of each thousand orders: a ring of 100, a chain of 100 that hangs on it, chains of 50 to a root, and lost parents.
PARENT = "CASE WHEN o_orderkey % 1000 < 100 THEN o_orderkey - o_orderkey % 1000 + (o_orderkey % 1000 + 1) % 100 WHEN o_orderkey % 1000 = 777 THEN -1 WHEN o_orderkey % 1000 < 200 OR o_orderkey % 50 <> 0 THEN o_orderkey - 1 END"


@query(f"""WITH RECURSIVE f AS (SELECT o_orderkey AS id, {PARENT} AS parent FROM orders),
ends(id) AS (SELECT id FROM f WHERE parent IS NULL OR parent NOT IN (SELECT id FROM f) UNION ALL SELECT f.id FROM f JOIN ends e ON f.parent = e.id)
SELECT id, 'PARENT_CYCLE' AS violation, id % 1000 < 100 AS on_cycle FROM f WHERE id NOT IN (SELECT id FROM ends) UNION ALL SELECT id, 'PARENT_MISSING', false FROM f WHERE parent NOT IN (SELECT id FROM f)""")
def parent_chains(t):
    """All fragments whose chain of parents enters a cycle, also those that only hang on it."""
    return claims.parent_cycles(t.orders.select(F.col("o_orderkey").alias("id"), F.expr(PARENT).alias("parent")))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderdate AS approved, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY END AS expires, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sup FROM orders),
s AS (SELECT *, CASE WHEN approved > TIMESTAMP '1996-06-01' THEN 'stale' WHEN expires <= TIMESTAMP '1996-06-01' THEN 'expired' ELSE 'active' END AS state FROM a)
SELECT id, CASE WHEN state = 'active' AND id IN (SELECT sup FROM s WHERE state = 'active' AND sup IS NOT NULL) THEN 'superseded' ELSE state END AS state FROM s""")
def supersession_chain(t):
    from pyspark.sql.window import Window as W

    own = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("s").alias("scope"), F.col("o_orderdate").alias("approved_at"), F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY END").alias("expires_at"), F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("supersedes"))
    return claims.supersession(own, F.lit("1996-06-01").cast("timestamp_ntz")).select("id", "state")


@query(f"""WITH RECURSIVE f AS (SELECT o_orderkey AS id, {PARENT} AS sup, o_orderkey % 7 = 0 AS scope, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE sha256(({PARENT})::VARCHAR) END AS said FROM orders),
ends(id) AS (SELECT id FROM f WHERE sup IS NULL OR sup NOT IN (SELECT id FROM f) UNION ALL SELECT f.id FROM f JOIN ends e ON f.sup = e.id),
m AS (SELECT f.id, f.scope <> o.scope AS other, f.said <> sha256(o.id::VARCHAR) AS broken FROM f JOIN f o ON o.id = f.sup)
SELECT id, 'SUPERSESSION_CYCLE' AS violation FROM f WHERE id NOT IN (SELECT id FROM ends) UNION ALL SELECT id, 'SUPERSEDED_NOT_FOUND' FROM f WHERE sup NOT IN (SELECT id FROM f) UNION ALL SELECT id, 'OTHER_SCOPE' FROM m WHERE other UNION ALL SELECT id, 'DIGEST_MISMATCH' FROM m WHERE broken""")
def supersession_violations(t):
    parent = F.expr(PARENT)
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), parent.alias("supersedes"), (F.col("o_orderkey") % 7 == 0).alias("scope"), F.lit("t").alias("target"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"),
        F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.sha2(parent.cast("string"), 256)).alias("previous_digest"),
    )
    return claims.supersession_violations(rows)


@query("SELECT event_id, '/' || k AS path, json_extract(props, '$.' || k)::VARCHAR AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_leaf_walk(t):
    return json_text.json_leaves(t.events, "props", ["event_id"]).select("event_id", "path", "value")


@query("""SELECT p_partkey, path, value FROM (SELECT p_partkey, unnest(['/brand', '/name', '/parameters/' || p_brand || '/name', '/parameters/' || p_brand || '/type', '/size']) AS path, unnest([p_brand, p_name, p_brand, p_type, CASE WHEN p_size > 10 THEN p_size::VARCHAR END]) AS value FROM part) WHERE value IS NOT NULL""")
def claim_path_flatten(t):
    params = F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("type")))
    flat = claims.claim_paths({"brand": F.col("p_brand"), "name": F.col("p_name"), "size": F.when(F.col("p_size") > 10, F.col("p_size"))}, {"parameters": (params, "name", ["type"])})
    return t.part.select("p_partkey", F.explode(flat).alias("x")).select("p_partkey", "x.path", "x.value")


EDGES_SQL = ", ".join(f"'{e}'" for e in lifecycle.edge_keys())
TARGETS = ["acquired", "claims_proposed", "reconciled", "contract_built", "validated", "approval_ready", "approved", "published", "stale"]


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events),
x AS (SELECT *, [{', '.join(f"'{s}'" for s in TARGETS)}][((ord - 1 + CASE WHEN ord > 4 AND user_id % 3 = 0 THEN 1 ELSE 0 END) % 9)::INT + 1] AS target FROM e),
s AS (SELECT event_id, user_id, ord, target, 'registered' AS state FROM x WHERE ord = 1
  UNION ALL SELECT x.event_id, x.user_id, x.ord, x.target, CASE WHEN s.state || '>' || s.target IN ({EDGES_SQL}) AND NOT (s.target = 'approved' AND s.user_id % 2 = 0) THEN s.target ELSE s.state END FROM s JOIN x ON x.user_id = s.user_id AND x.ord = s.ord + 1)
SELECT event_id, user_id, target, state, CASE WHEN state || '>' || target NOT IN ({EDGES_SQL}) THEN 'illegal_edge' WHEN target = 'approved' AND user_id % 2 = 0 THEN 'wrong_actor' ELSE 'accepted' END AS verdict FROM s""")
def lifecycle_fold(t):
    from pyspark.sql.window import Window as W

    e = t.events.select("event_id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"))
    at = ((F.col("ord") - 1 + F.expr("CASE WHEN ord > 4 AND user_id % 3 = 0 THEN 1 ELSE 0 END")) % 9 + 1).cast("int")
    actor = F.expr("CASE WHEN target = 'approved' AND user_id % 2 = 0 THEN 'runtime' WHEN target = 'approved' THEN 'approver' WHEN target = 'published' THEN 'publisher' ELSE 'system' END")
    steps = e.withColumn("target", F.element_at(F.array(*map(F.lit, TARGETS)), at)).withColumns({"actor": actor, "key": F.col("event_id").cast("string")})
    have = ["evidence_bundle", "runtime_result", "grounded_claims", "contract", "validation_decision", "candidate_release", "projections"]
    steps = steps.withColumn("artifacts", F.array(*map(F.lit, have))).withColumnRenamed("user_id", "aggregate_id")
    return lifecycle.check_transitions(steps).select("event_id", F.col("aggregate_id").alias("user_id"), "target", "state", "verdict")


@query("""WITH c AS (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS v, generate_subscripts(string_split(o_orderpriority, '-'), 1) AS i FROM orders) SELECT o_orderkey, trim(v) AS cell, (i - 1)::INT AS pos FROM c""")
def table_cells(t):
    row = F.concat(F.lit("| "), F.replace("o_orderpriority", F.lit("-"), F.lit(" | ")), F.lit(" |"))
    return t.orders.select("o_orderkey", F.posexplode(text.table_cells(row)).alias("pos", "cell"))


@query("SELECT n_nationkey, 'operation:GET:/' || lower(n_name) AS operation, 'schema:' || n_name AS schema, 'claim:operation:' || n_name || ':summary' AS claim, 'POST /' || n_name AS endpoint FROM nation")
def canonical_identities(t):
    path = F.concat(F.lit("/"), F.lower("n_name"))
    return t.nation.select("n_nationkey", identity.operation_identity(F.lit(" get "), path).alias("operation"), identity.schema_identity(F.concat(F.lit(" "), "n_name")).alias("schema"), identity.claim_identity(F.lit("operation"), F.col("n_name"), F.lit("summary")).alias("claim"), identity.endpoint_identity(F.lit("post"), F.concat(F.lit("/"), "n_name"), F.lit(None).cast("string")).alias("endpoint"))


@query("SELECT s_suppkey, 'SQ-' || lpad((row_number() OVER (ORDER BY s_nationkey, s_suppkey))::VARCHAR, 3, '0') AS id FROM supplier WHERE s_suppkey < 900")
def sequential_numbering(t):
    return sequential_ids(t.supplier.where("s_suppkey < 900").select("s_suppkey", "s_nationkey"), "SQ-", ["s_nationkey", "s_suppkey"]).select("s_suppkey", "id")


@query("SELECT o_orderkey, printf('SQ-%03d', row_number() OVER (ORDER BY o_orderpriority, o_orderkey)) AS id FROM orders")
def sequential_numbering_whole(t):
    """All orders, of which there are more than three digits can number."""
    return sequential_ids(t.orders.select("o_orderkey", "o_orderpriority"), "SQ-", ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "id")


@query("SELECT s_suppkey, CASE WHEN r > 1 THEN n || '#' || r ELSE n END AS key FROM (SELECT s_suppkey, 'n' || s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)")
def occurrence_suffix(t):
    rows = t.supplier.select("s_suppkey", F.concat(F.lit("n"), "s_nationkey").alias("n"))
    return occurrence_keys(rows, "n", "s_suppkey").select("s_suppkey", "key")


@query("""WITH o AS (SELECT p_partkey AS location, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 'GET' END AS method, CASE WHEN p_size % 7 = 0 THEN 0 ELSE 2 END AS nr, CASE WHEN p_size % 6 = 0 THEN '' ELSE p_name END AS summary, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS ne FROM part)
SELECT 'REQUIRED_INFO_MISSING' AS code, 'error' AS severity, location, 'method' AS evidence FROM o WHERE method IS NULL UNION ALL SELECT 'REQUIRED_INFO_MISSING', 'error', location, 'responses' FROM o WHERE nr = 0 UNION ALL SELECT 'REQUIRED_INFO_MISSING', 'warning', location, 'summary' FROM o WHERE summary = '' UNION ALL SELECT 'REQUIRED_INFO_MISSING', 'warning', location, 'examples' FROM o WHERE ne = 0""")
def completeness_findings(t):
    ops = t.part.select(F.col("p_partkey").alias("location"), F.expr("CASE WHEN p_size % 10 = 0 THEN NULL ELSE 'GET' END").alias("method"), F.expr("CASE WHEN p_size % 7 = 0 THEN 0 ELSE 2 END").alias("n_responses"), F.expr("CASE WHEN p_size % 6 = 0 THEN '' ELSE p_name END").alias("summary"), F.expr("CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END").alias("n_examples"), F.lit("s").alias("server"), F.lit("supported").alias("status"))
    return validators.completeness(ops)


@query("WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity = 50), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) SELECT 'OUTPUT_MISMATCH' AS code, 'error' AS severity, coalesce(a.k, b.k)::VARCHAR AS location, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS evidence FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def consistency_findings(t):
    return validators.consistency(t.lineitem.where("l_quantity = 50").select(F.col("l_suppkey").alias("k")), t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), "k")


@query("""WITH p AS (SELECT l_partkey AS target, bool_or(l_returnflag = 'N') AS ok, bool_or(l_discount = 0.1 AND l_quantity = 50) AS clash FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), t AS (SELECT p_partkey AS target, p_partkey // 10 AS parent FROM part),
m AS (SELECT t.target, coalesce(a.ok, b.ok) AS ok, coalesce(a.clash, b.clash) AS clash FROM t LEFT JOIN p a ON a.target = t.target LEFT JOIN p b ON b.target = t.parent)
SELECT target, CASE WHEN ok IS NULL THEN 'UNSUPPORTED_ASSERTION' WHEN clash THEN 'SOURCE_CONFLICT' ELSE 'SOURCE_UNVERIFIED' END AS code FROM m WHERE ok IS NULL OR clash OR NOT ok""")
def speculation_findings(t):
    status = F.expr("CASE WHEN l_discount = 0.1 AND l_quantity = 50 THEN 'conflicting' WHEN l_returnflag = 'N' THEN 'supported' ELSE 'unverified' END")
    rows = t.lineitem.where("l_linenumber = 1")
    cited = rows.select(F.col("l_partkey").alias("target"), status.alias("status")).unionByName(rows.where("l_discount = 0.1 AND l_quantity = 50 AND l_returnflag = 'N'").select(F.col("l_partkey").alias("target"), F.lit("supported").alias("status")))
    return validators.speculation(t.part.select(F.col("p_partkey").alias("target"), F.expr("p_partkey div 10").alias("parent")), cited)


@query("SELECT l_suppkey AS location, count(*) AS n FROM lineitem WHERE l_partkey % 40 = 0 GROUP BY 1 HAVING bool_and(l_returnflag <> 'N')")
def supplementary_support(t):
    rows = t.lineitem.where("l_partkey % 40 = 0").select(F.col("l_suppkey").alias("location"), F.expr("CASE WHEN l_returnflag = 'N' THEN 'normative' ELSE 'supplementary' END").alias("authority"))
    return validators.supplementary_only(rows, "location")


@query("SELECT l_orderkey AS scope, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 30 GROUP BY 1 HAVING NOT bool_or(p_partkey IS NOT NULL)")
def unresolved_citation_scopes(t):
    rows = t.lineitem.join(t.part.where("p_size > 30").select(F.col("p_partkey").alias("l_partkey"), F.lit("x").alias("source")), "l_partkey", "left").select(F.col("l_orderkey").alias("scope"), "source")
    return validators.unresolved_scopes(rows, "scope")


@query("WITH e AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_name ELSE '/' || p_name END AS path, CASE WHEN p_size % 2 = 0 THEN ' ' ELSE 's' END AS summary FROM part) SELECT p_partkey, CASE WHEN path IS NOT NULL THEN 'PATH_NOT_ABSOLUTE' ELSE 'WEBHOOK_UNNAMED' END AS code FROM e WHERE (path IS NOT NULL AND path NOT LIKE '/%') OR (path IS NULL AND trim(summary) = '')")
def bad_paths(t):
    rows = t.part.select("p_partkey", F.expr("CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_name ELSE concat('/', p_name) END").alias("path"), F.expr("CASE WHEN p_size % 2 = 0 THEN ' ' ELSE 's' END").alias("summary"))
    return validators.bad_paths(rows, "path", "summary").select("p_partkey", "code")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'missing' ELSE 'digest' END AS reason FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <> 9 WHERE p_partkey IS NULL OR (CASE WHEN l_quantity > 40 THEN 'x' ELSE p_brand END) <> p_brand")
def evidence_reference_check(t):
    refs = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("fragment_id"), F.expr("CASE WHEN l_quantity > 40 THEN 'x' ELSE p_brand END").alias("digest"))
    return validators.evidence_mismatches(refs, t.part.where("p_size != 9").select(F.col("p_partkey").alias("fragment_id"), F.col("p_brand").alias("digest"))).select("l_orderkey", "l_linenumber", "reason")


@query("SELECT n_nationkey, coalesce(f, 0) AS n_facts, coalesce(m, 0) AS n_matched, coalesce(m, 0) = 0 OR n_nationkey % 8 = 0 AS unscanned FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS f, count(*) FILTER (WHERE s_acctbal > 5000) AS m FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def fact_coverage(t):
    sources = t.nation.select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") % 8 == 0).alias("unclosed_fence"))
    known = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("identity"))
    return validators.fact_coverage(sources, t.supplier.select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("identity")), known).select(F.col("source").alias("n_nationkey"), "n_facts", "n_matched", "unscanned")


@query("SELECT o_orderkey, code FROM orders, (VALUES ('E1', 'f'), ('E2', 'o'), ('E3', 'F')) v(code, s) WHERE lower(o_orderstatus) = lower(s)")
def applicable_errors(t):
    codes = t.spark.sql("SELECT * FROM VALUES ('E1', array(' get /F')), ('E2', array('GET /o')), ('E3', array('Get /f')) AS v(code, applicable_to)")
    ops = t.orders.select("o_orderkey", F.lit("GET").alias("method"), F.concat(F.lit("/"), "o_orderstatus").alias("path"))
    return validators.applicable_errors(codes, ops).select("o_orderkey", "code")


@query("""WITH f AS (SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_returnflag = 'A' THEN 'error' ELSE 'warning' END AS sev0, l_returnflag AS code, CASE WHEN l_linenumber = 1 THEN 7 END AS w FROM lineitem), x AS (SELECT k, w, CASE code WHEN 'A' THEN 'warning' ELSE sev0 END AS sev FROM f)
SELECT k, CASE WHEN bool_or(w IS NULL AND sev = 'error') THEN 'reject' WHEN bool_or(w IS NULL AND sev = 'warning') THEN 'review' ELSE 'accept' END AS decision, count(*) AS n FROM x GROUP BY k""")
def policy_decision(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.expr("CASE WHEN l_returnflag IN ('R', 'A') THEN 'error' ELSE 'warning' END").alias("severity"), F.col("l_returnflag").alias("code"), F.expr("CASE WHEN l_linenumber = 1 THEN 7 END").alias("waiver_id"))
    return scoring.policy_decision(rows, t.spark.sql("SELECT 'A' AS code, 'warning' AS new_severity"), ["k"])


@query("SELECT l_suppkey, ['supported', 'missing', 'unverified', 'conflicting'][max(CASE WHEN l_quantity > 49 THEN 4 WHEN l_tax = 0 THEN 3 WHEN l_discount = 0 THEN 2 ELSE 1 END)] AS status FROM lineitem GROUP BY 1")
def strictest_status(t):
    rows = t.lineitem.select("l_suppkey", F.expr("CASE WHEN l_quantity > 49 THEN 'conflicting' WHEN l_tax = 0 THEN 'unverified' WHEN l_discount = 0 THEN 'missing' ELSE 'supported' END").alias("status"))
    return claims.merge_status(rows, ["l_suppkey"])


@query("SELECT o_orderkey, unnest(list_distinct([upper(m), 'POST', 'GET'])) AS method FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'get' ELSE 'put' END AS m FROM orders)")
def expand_methods(t):
    rows = t.orders.select("o_orderkey", F.expr("CASE o_orderstatus WHEN 'F' THEN 'GET' ELSE 'PUT' END").alias("method"), F.array(F.lit("POST"), F.lit("GET")).alias("methods"))
    return claims.expand_methods(rows).select("o_orderkey", "method")


@query("""WITH b AS (SELECT p_partkey AS owner, '/brand' AS path, p_type AS s0, p_size % 2 = 0 AS r0 FROM part WHERE p_size % 9 <> 1), h AS (SELECT p_partkey AS owner, '/brand' AS path, CASE WHEN p_size % 7 = 0 THEN 'x' ELSE p_type END AS s1, p_size % 3 = 0 AS r1 FROM part WHERE p_size % 9 <> 2), m AS (SELECT * FROM b FULL JOIN h USING (owner, path))
SELECT owner, path, 'breaking' AS impact, 'required property added' AS summary FROM m WHERE s0 IS NULL AND r1 UNION ALL SELECT owner, path, 'additive', 'optional property added' FROM m WHERE s0 IS NULL AND NOT r1 UNION ALL SELECT owner, path, 'changed', 'property removed' FROM m WHERE s1 IS NULL
UNION ALL SELECT owner, path, 'breaking', 'signature changed' FROM m WHERE s0 <> s1 UNION ALL SELECT owner, path, 'breaking', 'property became required' FROM m WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND NOT r0 AND r1 UNION ALL SELECT owner, path, 'changed', 'property no longer required' FROM m WHERE r0 AND NOT coalesce(r1, false)""")
def schema_compare_request(t):
    base = t.part.where("p_size % 9 != 1").select(F.col("p_partkey").alias("owner"), F.lit("/brand").alias("path"), F.col("p_type").alias("signature"), F.expr("p_size % 2 = 0").alias("required"))
    head = t.part.where("p_size % 9 != 2").select(F.col("p_partkey").alias("owner"), F.lit("/brand").alias("path"), F.expr("CASE WHEN p_size % 7 = 0 THEN 'x' ELSE p_type END").alias("signature"), F.expr("p_size % 3 = 0").alias("required"))
    return compare.compare_schemas(base, head, "request")


@query("""WITH k AS (SELECT p_partkey, ['operation', 'parameter', 'media_type', 'schema', 'body', 'summary', 'provenance'][p_partkey % 7 + 1] AS area, p_name AS location, p_brand AS v, p_size % 2 = 0 AS r, p_size FROM part), b AS (SELECT * FROM k WHERE p_size % 9 <> 1), h AS (SELECT p_partkey, area, location, CASE WHEN p_size % 5 = 0 THEN 'x' ELSE v END AS v, CASE WHEN area = 'body' AND p_size % 4 = 0 THEN NOT r ELSE r END AS r, p_size FROM k WHERE p_size % 9 <> 2),
m AS (SELECT area, location, b.v AS v0, h.v AS v1, b.r AS r0, h.r AS r1 FROM b FULL JOIN h USING (area, location))
SELECT CASE WHEN area = 'provenance' THEN 'source_only' WHEN v0 IS NULL THEN (CASE WHEN area = 'parameter' AND r1 THEN 'breaking' ELSE 'additive' END) WHEN v1 IS NULL THEN (CASE WHEN area IN ('parameter', 'schema') THEN 'changed' ELSE 'breaking' END) WHEN area = 'body' THEN (CASE WHEN NOT r0 AND r1 THEN 'breaking' ELSE 'changed' END) WHEN area = 'summary' THEN 'changed' ELSE 'breaking' END AS impact, area, location, area || CASE WHEN v0 IS NULL THEN ' added' WHEN v1 IS NULL THEN ' removed' ELSE ' changed' END AS summary
FROM m WHERE v0 IS NULL OR v1 IS NULL OR v0 <> v1 OR r0 <> r1""")
def contract_diff(t):
    area = F.element_at(F.array(*map(F.lit, ["operation", "parameter", "media_type", "schema", "body", "summary", "provenance"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    k = t.part.select(area.alias("kind"), F.col("p_name").alias("key"), F.col("p_brand").alias("value"), F.expr("p_size % 2 = 0").alias("required"), "p_size")
    head = k.where("p_size % 9 != 2").withColumns({"value": F.expr("CASE WHEN p_size % 5 = 0 THEN 'x' ELSE value END"), "required": F.expr("CASE WHEN kind = 'body' AND p_size % 4 = 0 THEN NOT required ELSE required END")})
    return compare.compare_parts(k.where("p_size % 9 != 1"), head)


@query("""WITH m AS (SELECT l_linestatus, l_returnflag || l_linenumber AS metric, count(*)::DOUBLE AS value FROM lineitem WHERE l_linenumber <> 3 OR l_linestatus = 'F' GROUP BY ALL), b AS (SELECT * FROM m WHERE l_linestatus = 'F'), c AS (SELECT * FROM m WHERE l_linestatus = 'O')
SELECT coalesce(b.metric, c.metric) AS metric, b.value AS baseline, c.value AS candidate, c.value - b.value AS delta FROM b FULL JOIN c ON b.metric = c.metric""")
def replay_deltas(t):
    """Counts of lines by flag and number, closed ones as the baseline of open ones."""
    rows = t.lineitem.where("l_linenumber != 3 or l_linestatus = 'F'").groupBy("l_linestatus", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return compare.metric_deltas(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"))


@query("WITH l AS (SELECT DISTINCT l_returnflag AS code, l_partkey AS place FROM lineitem WHERE l_linenumber = 1), c AS (SELECT DISTINCT l_returnflag AS code, l_partkey AS place FROM lineitem WHERE l_linenumber = 2) SELECT coalesce(l.code, c.code) AS code, CASE WHEN c.code IS NULL THEN 'left' ELSE 'right' END AS side, count(*) AS n FROM l FULL JOIN c ON l.code = c.code AND l.place = c.place WHERE l.code IS NULL OR c.code IS NULL GROUP BY ALL")
def shadow_comparison(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("code"), F.col("l_partkey").alias("place"), "l_linenumber")
    return compare.shadow_comparison(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"), ["code", "place"])


@query("SELECT user_id, CASE WHEN bool_or(value > 100) THEN 'reject' ELSE 'accept' END AS verdict, CASE WHEN bool_or(value > 100) THEN string_agg(DISTINCT event_type, ',' ORDER BY event_type) ELSE '' END AS refs FROM events GROUP BY user_id")
def quality_supplements(t):
    rows = t.events.select("user_id", F.col("event_type").alias("ref"), F.lit(0).alias("at"), F.expr("CASE WHEN value > 100 THEN 'blocker' ELSE 'warning' END").alias("severity"))
    return risk.supplements(rows, ["user_id"], "ref", "at").select("user_id", "verdict", F.array_join("refs", ",").alias("refs"))
