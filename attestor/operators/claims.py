"""Claims and evidence: verification, reconciliation, paths, metrics, chains (G01, G11, J-EQ8, J-EQ12, N01, N06, R01, R03, U03, V19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attestor.functions.json_text import pointer_escape
from attestor.session import Workspace


def claim_paths(fields: dict[str, Column], lists: dict[str, tuple[Column, str, list[str]]] | None = None) -> Column:
    """Array of (path, value) of a claim's scalar fields and of its keyed lists, nulls left out.

    ``lists`` maps a prefix to (array of structs, name field, other fields): each element gives ``/prefix/name/field``.
    """
    flat = F.array(*[F.struct(F.lit(f"/{k}").alias("path"), v.cast("string").alias("value")) for k, v in fields.items()])
    for prefix, (items, name, others) in (lists or {}).items():
        for field in [name, *others]:
            flat = F.concat(flat, _list_paths(items, prefix, name, field))
    return F.array_sort(F.filter(flat, lambda x: x.value.isNotNull()))


def _list_paths(items: Column, prefix: str, name: str, field: str) -> Column:
    return F.transform(items, lambda x: F.struct(F.concat(F.lit(f"/{prefix}/"), pointer_escape(x[name].cast("string")), F.lit(f"/{field}")).alias("path"), x[field].cast("string").alias("value")))


def verify_support(support: DataFrame, fragments: DataFrame) -> DataFrame:
    """A relationship and a reason for each proposed support, by a ladder of which the first rung that fails decides (J-EQ8).

    ``support``: (support_id, fragment_id, claim_value, path_known, proposed); ``fragments``: (id, precision, materialised, excerpt,
    digest, value, role). Values are canonical text.
    """
    counted = fragments.groupBy("id").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("precision", "materialised", "excerpt", "digest", "value", "role")])
    met = support.join(counted, F.col("fragment_id") == F.col("id"), "left")
    evidence = F.coalesce(F.when(F.col("role").isNotNull(), F.col("value")), F.col("excerpt"))
    reason = (
        F.when(F.col("copies") > 1, "DUPLICATE_FRAGMENT_ID")
        .when(F.col("id").isNull(), "FRAGMENT_NOT_FOUND")
        .when(F.col("precision") != "exact", "FRAGMENT_NOT_EXACT")
        .when(~F.col("materialised"), "FRAGMENT_NOT_MATERIALIZED")
        .when(F.sha2("excerpt", 256) != F.col("digest"), "FRAGMENT_DIGEST_MISMATCH")
        .when(~F.col("path_known"), "CLAIM_PATH_UNKNOWN")
        .when(evidence == F.col("claim_value"), F.lit(None).cast("string"))
        .when(F.col("role").isNotNull(), "EVIDENCE_VALUE_MISMATCH")
        .otherwise("FRAGMENT_NOT_VALUE_BEARING")
    )
    out = met.withColumn("reason_code", reason)
    relation = F.when(F.col("reason_code").isNull(), F.col("proposed")).when(F.col("reason_code") == "EVIDENCE_VALUE_MISMATCH", "contradicts").otherwise("insufficient")
    return out.select(*support.columns, relation.alias("relationship"), "reason_code")


def reconcile(proposals: DataFrame) -> DataFrame:
    """(identity, status, value, n_proposals) from proposals (identity, id, value, supported, contradicted).

    Any contradiction conflicts; else one distinct supported value is supported and several conflict; else null values
    throughout are missing and the value of the lowest id is unverified. Values of a conflict are listed in order.
    One aggregation with partial sums and sets of distinct values.
    """
    g = proposals.groupBy("identity").agg(
        F.bool_or("contradicted").alias("against"),
        F.sort_array(F.collect_set(F.when(F.col("supported") & ~F.col("contradicted"), F.col("value")))).alias("values"),
        F.every(F.col("value").isNull()).alias("empty"),
        F.min_by("value", "id").alias("lowest"),
        F.count("*").alias("n_proposals"),
    )
    n = F.size("values")
    status = F.when(F.col("against"), "conflicting").when(n == 1, "supported").when(n > 1, "conflicting").when(F.col("empty"), "missing").otherwise("unverified")
    joined = F.array_join("values", "|")
    value = F.when(F.col("status").isin("supported", "conflicting"), F.when(n > 0, joined)).when(F.col("status") == "unverified", F.col("lowest"))
    return g.withColumn("status", status).select("identity", "status", value.alias("value"), "n_proposals")


def superseded(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Identities that an earlier run had and this one lacks."""
    return previous.join(current, "identity", "left_anti").select("identity", F.lit("superseded").alias("status"))


def uncovered_paths(required: DataFrame, supported: DataFrame) -> DataFrame:
    return required.join(supported, ["identity", "path"], "left_anti")


def parent_cycles(fragments: DataFrame) -> DataFrame:
    """(id, violation, on_cycle) of fragments (id, parent): a parent that is not there, or a chain that never ends.

    Every fragment whose chain enters a cycle counts; ``on_cycle`` tells those that lie on it. Ids are unique. Pointers
    are doubled over written tables until no chain ends and no ancestor drops out: logarithmic rounds, no limit of depth.
    """
    work = Workspace(fragments.sparkSession, "parents")
    base = work.save(fragments.select("id", "parent"), "base")
    ids = base.select(F.col("id").alias("parent"))
    lost = base.where("parent is not null").join(ids, "parent", "left_anti").select("id", F.lit("PARENT_MISSING").alias("violation"), F.lit(False).alias("on_cycle"))
    live, state = endless(work, base.join(ids, "parent", "left_semi").select("id", F.col("parent").alias("at"))), None
    while (seen := live.agg(F.count_distinct("at")).first()[0]) != state:
        state, live = seen, _doubled(work, live)
    ring = live.select(F.col("at").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    found = live.select("id").join(ring, "id", "left").select("id", F.lit("PARENT_CYCLE").alias("violation"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    return lost.unionByName(found)


def _doubled(work: Workspace, live: DataFrame) -> DataFrame:
    """Pointers (id, at) twice as far, without those that end on the way; ``live``, written by ``work``, is deleted."""
    up = live.select(F.col("id").alias("at"), F.col("at").alias("next"))
    farther = work.save(live.join(up, "at").select("id", F.col("next").alias("at")), "live")
    work.drop(live)
    return farther


def endless(work: Workspace, steps: DataFrame) -> DataFrame:
    """(id, at) of those ``steps`` (id, at), ids unique, whose chain never ends, ``at`` some steps ahead; written.

    Pointers are doubled until no chain ends in a round: a longer chain that ends would hold some that do. Numbers of rows
    come from the files, so a round shuffles nothing but its join.
    """
    live, n = work.save(steps, "live"), None
    while (left := live.count()) != n:
        n, live = left, _doubled(work, live)
    return live


def supersession(amendments: DataFrame, now: Column, target: Column | None = None) -> DataFrame:
    """State of each amendment (id, scope, approved_at, expires_at, supersedes) at ``now`` (R03, composition).

    Another scope is inapplicable, a later approval stale, a passed expiry expired, else active; what an active amendment
    supersedes, and is itself active, is superseded.
    """
    state = F.when(F.lit(False) if target is None else F.col("scope") != target, "inapplicable").when(F.col("approved_at") > now, "stale").when(F.col("expires_at") <= now, "expired").otherwise("active")
    own = amendments.withColumn("state", state)
    over = own.where("state = 'active' and supersedes is not null").select(F.col("supersedes").alias("id"), F.lit(True).alias("__over")).distinct()
    met = own.join(over, "id", "left")
    return met.withColumn("state", F.when((F.col("state") == "active") & F.col("__over"), "superseded").otherwise(F.col("state"))).drop("__over")


def supersession_violations(amendments: DataFrame) -> DataFrame:
    """(id, violation) of amendments (id, supersedes, scope, target, digest, previous_digest) whose chain does not hold.

    A chain that comes back to itself, a predecessor that is not there, one of another scope or target, or one whose digest is
    not the one stated.

    Each amendment meets its predecessor once, both digests by 128 bits of their SHA-256, and what that tells is written; chains are then followed by id alone.
    """
    short = lambda digest: F.substring(F.unhex(F.sha2(digest, 256)), 1, 16)
    work = Workspace(amendments.sparkSession, "supersession")
    before = amendments.select(F.col("id").alias("supersedes"), F.col("scope").alias("old_scope"), F.col("target").alias("old_target"), short("digest").alias("old_digest"), F.lit(True).alias("found"))
    own = amendments.where("supersedes is not null").select("id", "supersedes", "scope", "target", short("previous_digest").alias("previous_digest"))
    same = F.col("scope").eqNullSafe(F.col("old_scope")) & F.col("target").eqNullSafe(F.col("old_target"))
    told = F.array(F.when(~same, "OTHER_SCOPE"), F.when(~F.col("previous_digest").eqNullSafe(F.col("old_digest")), "DIGEST_MISMATCH"))
    told = F.when(F.col("found"), F.filter(told, lambda x: x.isNotNull())).otherwise(F.array(F.lit("SUPERSEDED_NOT_FOUND")))
    met = work.save(own.join(before, "supersedes", "left").select("id", F.col("supersedes").alias("at"), "found", told.alias("told")), "met")
    loops = endless(work, met.where("found").select("id", "at")).select("id", F.lit("SUPERSESSION_CYCLE").alias("violation"))
    return loops.unionByName(met.select("id", F.explode("told").alias("violation")))


def claim_metrics(expected: DataFrame, observed: DataFrame, keys: list[str], groups: list[str] | None = None) -> DataFrame:
    """Precision, recall, omission, unsupported and accuracy of observed against expected keys.

    One full outer join of distinct keys. Nothing observed is precise only if nothing was expected; nothing expected is recalled.
    """
    groups = groups or []
    e = expected.select(*groups, *keys).distinct().withColumn("__e", F.lit(1))
    o = observed.select(*groups, *keys).distinct().withColumn("__o", F.lit(1))
    met = e.join(o, [*groups, *keys], "full_outer")
    n = met.groupBy(*groups).agg(F.count("__e").alias("e"), F.count("__o").alias("o"), F.count_if(F.col("__e").isNotNull() & F.col("__o").isNotNull()).alias("both"))
    precision = F.when(F.col("o") == 0, F.when(F.col("e") == 0, 1.0).otherwise(0.0)).otherwise(F.col("both") / F.col("o"))
    recall = F.when(F.col("e") == 0, 1.0).otherwise(F.col("both") / F.col("e"))
    union = F.col("e") + F.col("o") - F.col("both")
    return n.select(*groups, F.col("e").alias("n_expected"), F.col("o").alias("n_observed"), precision.alias("precision"), recall.alias("recall"), (1 - precision).alias("unsupported"), (1 - recall).alias("omission"), F.when(union == 0, 1.0).otherwise(F.col("both") / union).alias("accuracy"))


def expand_methods(entries: DataFrame) -> DataFrame:
    """A row for each method of an entry: its own, then those of its ``methods`` array, each once."""
    every = F.array_distinct(F.filter(F.concat(F.array("method"), F.coalesce("methods", F.array().cast("array<string>"))), lambda m: m.isNotNull()))
    return entries.withColumn("method", F.explode(F.transform(every, lambda m: F.upper(F.trim(m))))).drop("methods")


def evidence_by_target(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with the evidence of exactly their target; a field never falls back to its operation (J-EQ12)."""
    return findings.join(evidence.groupBy("target").agg(F.sort_array(F.collect_set("fragment_id")).alias("fragments")), "target", "left")


def contract_collections(claims: DataFrame) -> DataFrame:
    """Where each reconciled claim goes in a contract: its kind's collection, gaps or conflicts."""
    place = F.when(F.col("status") == "supported", F.col("kind")).when(F.col("status") == "conflicting", "conflicts").otherwise("gaps")
    return claims.withColumn("collection", place)


def merge_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The strictest status of each key: supported, missing, unverified, conflicting in rising order (plan rank)."""
    ranks = ["supported", "missing", "unverified", "conflicting"]
    rank = F.max(F.array_position(F.array(*map(F.lit, ranks)), F.col("status")))
    return rows.groupBy(*keys).agg(rank.alias("__rank")).select(*keys, F.element_at(F.array(*map(F.lit, ranks)), F.col("__rank").cast("int")).alias("status"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order, as an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*[F.col(o) for o in order], *[F.col(c).alias(f"__{c}") for c in rest])).alias("r"))
    return least.select(*keys, *[F.col(f"r.__{c}").alias(c) for c in rest])


def ordered_union(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of each key in order of first mention."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def intersect_lists(rows: DataFrame, keys: list[str], value: str, unit: str) -> DataFrame:
    """Values that every unit of a key has (G02), by counting units instead of folding arrays."""
    units = rows.groupBy(*keys).agg(F.count_distinct(unit).alias("units"))
    have = rows.select(*keys, value, unit).distinct().groupBy(*keys, value).agg(F.count("*").alias("n"))
    return have.join(units, keys).where("n = units").select(*keys, value)


def latest_valid(assets: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """The asset in force at ``now`` for each key: approved by then, not past its end, the latest approval (J-ASOF)."""
    valid = assets.where((F.col("approved_at") <= now) & (F.col("valid_until").isNull() | (F.col("valid_until") > now)))
    return valid.groupBy(*keys).agg(F.max_by("asset_id", F.struct("approved_at", "asset_id")).alias("asset_id"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before it.

    Both sides are laid on one time line and the last right row is carried forward in a window, one shuffle and no range join.
    """
    cols = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*cols).alias("__left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__right"))
    b = right.select(*keys, F.col(since).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.struct(*values).alias("__right"))
    last = F.last("__right", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("__got", last).where("__side = 1").select(*keys, F.col("__t").alias(at), "__left.*", *[F.col(f"__got.{v}").alias(v) for v in values])


def waived(findings: DataFrame, waivers: DataFrame, now: Column) -> DataFrame:
    """Findings (finding_id, identity, location) with the first waiver that names their claim, has not expired and covers the location (J-EQ10)."""
    w = waivers.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("identity", "waiver_id", "scope")
    met = findings.join(w, "identity", "left").where("waiver_id is null or size(scope) = 0 or array_contains(scope, location)")
    first = met.groupBy("finding_id").agg(F.min("waiver_id").alias("waiver_id"))
    return findings.join(first, "finding_id", "left")
