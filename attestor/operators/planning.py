"""Normalisation plans: details met with endpoints, merged fields, unique keys, nested fields, plan items (J-EQ1, J-EQ2, G04, F12, N02, N07, V06, V12, S06)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from attestor.functions.text import component_base, webhook_label
from attestor.operators.claims import first_wins
from attestor.session import Workspace

#: Stages whose answers are structured, and the area each fills.
STAGES = {"03": "environments", "04": "security_schemes", "05": "endpoints", "06": "endpoint_details", "07": "schemas", "08": "errors", "09": "operational"}


def build_manifest(local: DataFrame, urls: DataFrame) -> DataFrame:
    """Local files and URL sources as one list of documents (S06): (document, origin, sha256, and what either side has of its own)."""
    own = local.select(F.col("path").alias("document"), F.lit("local").alias("origin"), *[c for c in local.columns if c != "path"])
    far = urls.select(F.col("url").alias("document"), F.lit("url").alias("origin"), F.col("content_sha256").alias("sha256"), *[c for c in urls.columns if c not in ("url", "content_sha256")])
    return own.unionByName(far, allowMissingColumns=True)


def _method(column: str) -> Column:
    return F.lower(F.trim(column))


def match_details(endpoints: DataFrame, details: DataFrame) -> DataFrame:
    """The endpoint of each detail with a path (J-EQ1): (run, detail, endpoint, added).

    ``endpoints`` and ``details``: (run, ord, method, path). A detail belongs to the first endpoint of its run with its
    method, whatever its case, and its path; any number may share one. Where there is none, the first such detail is
    added as an endpoint (``endpoint`` null, ``added`` its own ord) and later ones belong to it. Details without method belong nowhere.
    """
    keys = ["run", "m", "path"]
    known = endpoints.where("path is not null").select("run", "ord", "path", _method("method").alias("m")).groupBy(*keys).agg(F.min("ord").alias("endpoint"))
    asked = details.where("path is not null and method is not null").select("run", "ord", "path", _method("method").alias("m"))
    first = asked.groupBy(*keys).agg(F.min("ord").alias("first"))
    place = first.join(known, keys, "left").select(*keys, "endpoint", F.when(F.col("endpoint").isNull(), F.col("first")).alias("added"))
    return asked.join(place, keys).select("run", F.col("ord").alias("detail"), "endpoint", "added")


def match_webhooks(endpoints: DataFrame, details: DataFrame) -> DataFrame:
    """The endpoint of each detail without path (J-EQ2): (run, detail, endpoint, added).

    ``endpoints``: (run, ord, method, path, locators, sources); ``details``: (run, ord, method, path, locator, source). In order of
    the details, each takes the first endpoint of its method without path that has its locator, else the first that has its
    source, and no endpoint is taken twice; a detail that finds none is added as an endpoint, which later details may take. The choice
    hangs on all before it, so the webhooks of one run and method are one group, bounded by one contract's callbacks.

    Groups are sorted into partitions and read in a stream, so that a small group costs no call of its own; of a group only the endpoints that are
    still free are held.
    """
    schema = "run string, detail long, endpoint long, added long"
    none = F.lit(None)
    e = endpoints.where("path is null").select(F.col("run").cast("string").alias("run"), _method("method").alias("m"), F.lit(0).alias("kind"), F.col("ord").cast("long").alias("ord"), "locators", "sources")
    d = details.where("path is null and method is not null").select(
        F.col("run").cast("string").alias("run"), _method("method").alias("m"), F.lit(1).alias("kind"), F.col("ord").cast("long").alias("ord"),
        F.when(F.col("locator") != "", F.array("locator")).otherwise(none).cast("array<string>").alias("locators"), F.when(F.col("source").isNotNull(), F.array("source")).otherwise(none).cast("array<string>").alias("sources"),
    )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, free = None, []
        for batch in batches:
            out = []
            for run, m, kind, ord_, locators, sources in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (run, m) != group:
                    group, free = (run, m), []
                where, what = set(locators or ()), set(sources or ())
                if kind == 0:
                    free.append((ord_, None, where, what))
                    continue
                for field, mine in ((2, where), (3, what)):
                    hit = next((i for i, x in enumerate(free) if mine & x[field]), None)
                    if hit is not None:
                        endpoint, added, _, _ = free.pop(hit)
                        out.append((run, ord_, endpoint, added))
                        break
                else:
                    free.append((None, ord_, where, what))
                    out.append((run, ord_, None, ord_))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate([pa.string(), pa.int64(), pa.int64(), pa.int64()])], names=["run", "detail", "endpoint", "added"])

    rows = e.unionByName(d).select("run", "m", "kind", "ord", "locators", "sources")
    return rows.repartition("run", "m").sortWithinPartitions("run", "m", "kind", "ord").mapInArrow(pair, schema)


def merged_fields(items: DataFrame) -> DataFrame:
    """What endpoints that fall together keep (G04) of items (run, endpoint, kind, name, ord, payload).

    Parameters (by name and place), responses (by status), tags and security keep the first of each name, a request the first that
    is there, examples all.
    """
    one = items.where(F.col("kind") != "examples").withColumn("name", F.when(F.col("kind") == "request", "").otherwise(F.col("name")))
    kept = first_wins(one.where("payload is not null"), ["run", "endpoint", "kind", "name"], ["ord"])
    return kept.select(*items.columns).unionByName(items.where("kind = 'examples'"))


def server_conflicts(endpoints: DataFrame) -> DataFrame:
    """(run, method, path, servers) of endpoints that fall together but name different servers."""
    servers = endpoints.where("server is not null").groupBy("run", _method("method").alias("method"), "path").agg(F.array_sort(F.collect_set("server")).alias("servers"))
    return servers.where(F.size("servers") > 1)


def schema_keys(schemas: DataFrame, prefix: str = "schema") -> DataFrame:
    """``schemas`` (run, ord, name) with ``key``, unique in each run.

    A name keeps letters, digits, dots, dashes and underscores; in order, a key already taken gets ``_2``, ``_3`` … until it is free. As a
    made key may take another's place, keys of a run are given one after another, in a group of one contract's schemas.
    """
    fields = [*schemas.schema.fields, T.StructField("key", T.StringType())]
    based = schemas.withColumn("key", component_base(F.coalesce("name", F.lit("")), F.row_number().over(W.partitionBy("run").orderBy("ord")) - 1, prefix))

    def give(group: pd.DataFrame) -> pd.DataFrame:
        group, used, keys = group.sort_values("ord"), set(), []
        for base in group.key:
            key, n = base, 2
            while key in used:
                key, n = f"{base}_{n}", n + 1
            used.add(key)
            keys.append(key)
        return group.assign(key=keys)

    return based.groupBy("run").applyInPandas(give, T.StructType(fields))


def webhook_keys(endpoints: DataFrame) -> DataFrame:
    """Endpoints (run, ord, method, path, summary) without path with ``key``: the label of their summary; repeats get 2, 3 …."""
    hooks = endpoints.where("coalesce(path, '') = '' and coalesce(method, '') != ''")
    order = W.partitionBy("run").orderBy("ord")
    label = webhook_label(F.trim(F.coalesce("summary", F.lit(""))))
    base = F.when(label != "", label).when(F.trim("summary") != "", F.trim("summary")).otherwise(F.concat(F.lit("webhook"), F.row_number().over(order) - 1))
    named = hooks.withColumn("base", base)
    n = F.row_number().over(W.partitionBy("run", "base").orderBy("ord"))
    return named.withColumn("key", F.when(n > 1, F.concat("base", n)).otherwise(F.col("base"))).drop("base")


def nested_fields(fields: DataFrame) -> DataFrame:
    """The tree that dotted names spell (N02): (owner, path, parent, key, kind, required, leaf, position).

    ``fields``: (owner, ord, name, required, is_union). ``A.b`` is a property of the object A, ``A[].b`` one of the objects in the
    array A. A node is required if its own field says so, and is described by the last field of its whole name (``leaf``, its
    ord). A union is terminal: what names spell below it is left out. Nodes stand in order of first mention.

    Fields are dealt out by owner once, before they are cut into steps, and nodes sorted by name: what a name spells below a node
    follows it at once, and ends before the name with ``/`` behind it, the character after the dot.
    """
    plain = lambda part: F.regexp_replace(part, r"\[\]$", "")
    named = fields.where("name is not null and name != ''").select("owner", "ord", "name", "required", "is_union").repartition("owner")
    split = named.withColumn("parts", F.split("name", r"\.")).withColumn("keys", F.transform("parts", plain))
    steps = split.select("owner", "ord", "required", "is_union", "keys", F.size("parts").alias("n"), F.posexplode("parts").alias("level", "part")).where(F.element_at("keys", F.col("level") + 1) != "")
    path = F.array_join(F.filter(F.slice("keys", F.lit(1), F.col("level") + 1), lambda k: k != ""), ".")
    steps = steps.select(
        "owner", F.concat(path, F.lit(".")).alias("inside"), F.struct("ord", "level").alias("position"), F.col("part").endswith("[]").alias("is_array"),
        F.when(F.col("level") == F.col("n") - 1, F.struct("ord", "required", "is_union")).alias("leaf"),
    )
    nodes = steps.groupBy("owner", "inside").agg(F.min("position").alias("position"), F.bool_or("is_array").alias("is_array"), F.max("leaf").alias("leaf")).withColumn("path", F.expr("left(inside, length(inside) - 1)"))
    order = W.partitionBy("owner").orderBy("inside")
    end = F.max(F.when(F.col("leaf.is_union"), F.concat("path", F.lit("/")))).over(order.rowsBetween(W.unboundedPreceding, -1))
    met = nodes.withColumns({"end": end, "has_children": F.coalesce(F.lead("inside").over(order).startswith(F.col("inside")), F.lit(False))}).where("end is null or end < inside")
    keys = F.split("path", r"\.")
    parent = F.array_join(F.slice(keys, F.lit(1), F.size(keys) - 1), ".")
    kind = F.when(F.coalesce("leaf.is_union", F.lit(False)), "union").when(~F.col("has_children"), "field").when(F.col("is_array"), "array").otherwise("object")
    return met.select("owner", "path", parent.alias("parent"), F.element_at(keys, -1).alias("key"), kind.alias("kind"), F.coalesce("leaf.required", F.lit(False)).alias("required"), F.col("leaf.ord").alias("leaf"), "position")


def reachable_names(names: DataFrame, refs: DataFrame, roots: DataFrame) -> DataFrame:
    """(owner, name) of the names each root spells itself or through the schemas it refers to, however far.

    ``names``: (node, name); ``refs``: (node, to_node); ``roots``: (owner). Names are compared in lower case. What is reached grows by one
    step of references a round, each written; a schema reached twice is not followed again, so that cycles end.
    """
    work = Workspace(names.sparkSession, "names")
    step = work.save(refs.select("node", "to_node").distinct(), "refs")
    reached = work.save(roots.select("owner", F.col("owner").alias("node")).distinct(), "reached")
    fresh = reached
    while not fresh.isEmpty():
        out = fresh.join(step, "node").select("owner", F.col("to_node").alias("node")).distinct()
        fresh = work.save(out.join(reached, ["owner", "node"], "left_anti"), "fresh")
        reached = reached.unionAll(fresh)
    return reached.join(names, "node").select("owner", F.lower("name").alias("name")).distinct()


def plan_items(answers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Items of all answers of an extraction as one table (V06): (run, stage, area, ord, status, source, payload), and a missing item for what is not there.

    ``answers``: (run, stage, query_id, items array<struct<source, missing, conflict, payload>>), null items where an answer was
    malformed; ``manifest``: (run, document, name). An item is supported where its source names a document of the run, or the run has only one;
    else it is unverified, conflicting where it says so, and missing where it says so. A stage without answer, and a malformed
    answer, are missing items themselves.
    """
    area = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    each = answers.where("items is not null").select("run", "stage", "query_id", F.posexplode("items").alias("ord", "item"))
    each = each.select("run", "stage", "query_id", "ord", "item.*").withColumn("name", F.lower("source"))
    known = manifest.select("run", F.lower("name").alias("name"), "document").groupBy("run", "name").agg(F.min("document").alias("document"))
    counts = manifest.groupBy("run").agg(F.count_distinct("document").alias("n_documents"))
    met = each.join(known, ["run", "name"], "left").join(counts, "run", "left")
    status = F.when(F.col("missing"), "missing").when(F.col("conflict"), "conflicting").when(F.col("document").isNotNull() | (F.col("n_documents") == 1), "supported").otherwise("unverified")
    found = met.select("run", "stage", "query_id", F.col("ord").cast("int").alias("ord"), status.alias("status"), F.col("document").alias("source"), "payload")
    broken = answers.where("items is null").select("run", "stage", "query_id", F.lit(-1).alias("ord"), F.lit("missing").alias("status"), F.lit(None).cast("string").alias("source"), F.lit("malformed answer").alias("payload"))
    stages = answers.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    silent = stages.join(answers.select("run", "stage").distinct(), ["run", "stage"], "left_anti").select("run", "stage", F.lit(None).cast("string").alias("query_id"), F.lit(-1).alias("ord"), F.lit("missing").alias("status"), F.lit(None).cast("string").alias("source"), F.lit("no structured answer").alias("payload"))
    return found.unionByName(broken).unionByName(silent).withColumn("area", F.element_at(area, F.col("stage")))


def integration_findings(entries: DataFrame, citations: DataFrame, refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Findings about an integration contract (V12): entries nobody cites, conflicts, unverified entries, references that lead nowhere.

    ``entries``: (run, location, status); ``citations``: (run, location); ``refs``: (run, location, ref); ``targets``: (run, ref).
    """
    cited = entries.join(citations.select("run", "location", F.lit(True).alias("cited")).distinct(), ["run", "location"], "left")
    code = F.when(F.col("cited").isNull(), "UNSUPPORTED_ASSERTION").when(F.col("status") == "conflicting", "SOURCE_CONFLICT").when(F.col("status") == "unverified", "SOURCE_UNVERIFIED")
    lost = refs.join(targets.select("run", "ref").distinct(), ["run", "ref"], "left_anti").select("run", "location", F.lit("OUTPUT_MISMATCH").alias("code"))
    return cited.select("run", "location", code.alias("code")).where("code is not null").unionByName(lost)
