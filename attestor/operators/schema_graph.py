"""Two versions of OpenAPI documents compared schema by schema, as pairs of nodes that descend together."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.operators.openapi import METHODS
from attestor.session import Workspace

#: What tells two schemas apart, but for their children.
SIGNATURE = ["type", "$ref", "enum", "oneOf", "anyOf", "allOf", "format"]
#: By area, whether a property that is now required breaks, and whether one that goes does.
RULES = {"openapi.requestBody": (True, False), "openapi.responses": (False, True), "openapi.schemas": (True, True)}
MAX_LEVELS = 200
#: Rows that are sent on at once.
BATCH_ROWS = 10_000
#: Characters of a version up to which a document is compared in one call; the nodes of longer ones meet by joins.
WHOLE_CHARS = 2_000_000

_NODE = "pointer string, signature string, is_object boolean, required array<string>, children map<string, string>, target string"
_PART = "kind string, area string, location string, parent string, value string, pointer string"
_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string, string>": pa.map_(pa.string(), pa.string())}


_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode
_SIGNED = frozenset(SIGNATURE)
_FOUND = "impact string, area string, location string, summary string"


def _dump(value) -> str:
    return _encode(value)


def _at(pointer: str, *keys: str) -> str:
    return pointer + "".join("/" + k.replace("~", "~0").replace("/", "~1") for k in keys)


def _dict(value, *keys: str) -> dict:
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}


def _roots(document: dict) -> Iterator[tuple]:
    """(kind, area, location, parent, value, keys, schema) of operations, bodies, responses, media types and components; parent is the part without which it is not compared."""
    for member, mark in (("paths", ""), ("webhooks", "webhooks:")):
        for path, item in _dict(document, member).items():
            for method, op in item.items() if isinstance(item, dict) else ():
                if method.lower() not in METHODS or not isinstance(op, dict):
                    continue
                key, at = f"{method.upper()} {mark}{path}", (member, path, method)
                yield "operation", None, key, None, None, None, None
                holders = []
                if isinstance(op.get("requestBody"), dict):
                    yield "body", "openapi.requestBody", f"{key} requestBody.required", key, "true" if op["requestBody"].get("required") else "false", None, None
                    holders.append(("request media type", "openapi.requestBody", f"{key} requestBody", key, op["requestBody"], (*at, "requestBody")))
                for status, answer in _dict(op, "responses").items():
                    name = f"{key} responses.{status}"
                    yield "response", "openapi.responses", name, key, None, None, None
                    holders.append(("response media type", "openapi.responses", name, name, answer, (*at, "responses", status)))
                for kind, area, name, parent, holder, place in holders:
                    for media, content in _dict(holder, "content").items():
                        if isinstance(content, dict) and isinstance(content.get("schema"), dict):
                            yield kind, area, f"{name}.{media}", parent, None, (*place, "content", media, "schema"), content["schema"]
    for name, schema in _dict(document, "components", "schemas").items():
        plain = not isinstance(schema, dict)
        yield "schema", "openapi.schemas", f"components.schemas.{name}", None, _dump(schema) if plain else None, None if plain else ("components", "schemas", name), None if plain else schema


def _parts(document: dict) -> Iterator[tuple]:
    """(kind, area, location, parent, value, pointer) of _roots()."""
    for *part, keys, _ in _roots(document):
        yield *part, keys and _at("", *keys)


def _is_object(node: dict) -> bool:
    return node.get("type") == "object" or "type" not in node and isinstance(node.get("properties"), dict)


def _target(node: dict) -> str | None:
    """The pointer that a local reference holds."""
    ref = node.get("$ref")
    return ref[1:] if isinstance(ref, str) and ref.startswith("#/components/schemas/") else None


def _nodes(document: dict) -> Iterator[tuple]:
    """(pointer, signature, is_object, required, children by step, where its local reference leads) of every schema."""
    todo = [(_at("", *keys), node) for *_, keys, node in _roots(document) if keys is not None]
    while todo:
        at, node = todo.pop()
        if not isinstance(node, dict):
            yield at, _dump(node), False, [], {}, None
            continue
        below = {f".{k}": (_at(at, "properties", k), v) for k, v in _dict(node, "properties").items()}
        if isinstance(node.get("items"), dict):
            below["[]"] = _at(at, "items"), node["items"]
        todo += below.values()
        listed = node.get("required")
        yield at, _dump(_signature(node)), _is_object(node), sorted({str(x) for x in listed}) if isinstance(listed, list) else [], {k: p for k, (p, _) in below.items()}, _target(node)


def _found_at(document: dict, pointer: str) -> tuple | None:
    """(mark, schema) that a local reference leads to; None where _nodes() has none."""
    keys = [k.replace("~1", "/").replace("~0", "~") for k in pointer.split("/")[1:]]
    node, i = _dict(document, *keys[:2]).get(keys[2]), 3
    if not isinstance(node, dict) or _at("", *keys) != pointer:
        return None
    mark = id(node)
    while i < len(keys):
        below = _dict(node, "properties") if keys[i] == "properties" else {}
        if i + 1 < len(keys) and keys[i + 1] in below:
            mark, node, i = (id(node), keys[i + 1]), below[keys[i + 1]], i + 2
        elif keys[i] == "items" and isinstance(_dict(node).get("items"), dict):
            node, i = node["items"], i + 1
        else:
            return None
        mark = id(node) if isinstance(node, dict) else mark
    return mark, node


def _signature(node):
    if not isinstance(node, dict):
        return node
    out = {k: v for k, v in node.items() if k in _SIGNED}
    if _is_object(node):
        out["type"] = "object"
    return out


def _unlike(a, b) -> bool:
    """Whether two schemas have different signatures."""
    a, b = _signature(a), _signature(b)
    if not isinstance(a, dict) or not isinstance(b, dict):
        return _dump(a) != _dump(b)
    if a.keys() != b.keys():
        return True
    for k, x in a.items():
        y = b[k]
        if x != y if isinstance(x, str) and isinstance(y, str) else _dump(x) != _dump(y):
            return True
    return False


def _differences(base: dict, head: dict, follow_refs: bool) -> Iterator[tuple[str, str, str, str]]:
    """(impact, area, location, summary) of two versions of one document: what compare_documents() tells, level by level.

    A schema is marked by its identity in memory, one that is no object by its owner's and its name: a place each.
    """
    old, new = defaultdict(list), defaultdict(list)
    for at, document in ((old, base), (new, head)):
        for kind, area, location, parent, value, _, node in _roots(document):
            at[kind, location].append((area, parent, value, node))
    shared = {location for kind, location in old.keys() & new.keys() if kind in ("operation", "response")}
    level, lacks = [], ((None, None, None, None),)
    for at in old.keys() | new.keys():
        (kind, location), had, has = at, at in old, at in new
        for a0, p0, v0, left in old[at] if had else lacks:
            for a1, p1, v1, right in new[at] if has else lacks:
                area = a1 if a0 is None else a0
                if kind == "operation" or kind != "schema" and (p1 if p0 is None else p0) not in shared:
                    continue
                if kind == "body":
                    if had and has and v0 != v1:
                        yield ("breaking", area, location, "request body became required") if v1 == "true" else ("changed", area, location, "request body no longer required")
                elif not had:
                    yield "additive", area, location, f"{kind} added"
                elif not has:
                    yield "changed" if kind == "schema" else "breaking", area, location, f"{kind} removed"
                elif left is not None and right is not None:
                    level.append((area, location, id(left), left, id(right), right))
                elif kind == "schema" and (left is not right or v0 != v1):
                    yield "breaking", area, location, "schema changed"

    seen = {(area, a, b) for area, _, a, _, b, _ in level} if follow_refs else set()
    while level:
        below = []
        for area, location, _, left, _, right in level:
            adds, removes = RULES[area]
            if _unlike(left, right):
                yield "breaking", area, location, "schema changed"
                if (isinstance(left, dict) and _is_object(left)) != (isinstance(right, dict) and _is_object(right)):
                    continue
            olds, news = _dict(left, "properties"), _dict(right, "properties")
            was, now = ({str(x) for x in listed} if isinstance(listed := s.get("required") if isinstance(s, dict) else None, list) else () for s in (left, right))
            for name, child in news.items():
                if name in olds:
                    other = olds[name]
                    below.append((area, f"{location}.{name}", id(other) if isinstance(other, dict) else (id(left), name), other, id(child) if isinstance(child, dict) else (id(right), name), child))
                elif adds and name in now:
                    yield "breaking", area, f"{location}.{name}", "required property added"
                else:
                    yield "additive", area, f"{location}.{name}", "optional property added"
            for name in olds:
                if name not in news:
                    yield "breaking" if removes else "changed", area, f"{location}.{name}", "property removed"
            for name in now:
                if name not in was and name in olds and name in news:
                    yield "breaking", area, f"{location}.{name}", "property became required"
            for name in was:
                if name not in now:
                    yield "changed", area, f"{location}.{name}", "property no longer required"
            if isinstance(left, dict) and isinstance(right, dict):
                a, b = left.get("items"), right.get("items")
                if isinstance(a, dict) and isinstance(b, dict):
                    below.append((area, f"{location}[]", id(a), a, id(b), b))
                if follow_refs and (a := _target(left)) is not None and (b := _target(right)) is not None and (a := _found_at(base, a)) and (b := _found_at(head, b)):
                    below.append((area, location, *a, *b))
        if follow_refs:  # a tree never comes back to a pair
            first = {}
            for pair in below:
                key = pair[0], pair[2], pair[4]
                if key not in seen and (key not in first or pair[1] < first[key][1]):
                    first[key] = pair
            below = list(first.values())
            seen |= first.keys()
        level = below


def read_documents(df: DataFrame, json_cols: list[str], keep: list[str], ddl: str, rows) -> DataFrame:
    """A row (*keep, ddl) for each that ``rows`` gives for the documents of a row; broken JSON and what is no object count as empty."""
    made = T.StructType.fromDDL(ddl)
    schema = T.StructType([*[df.schema[k] for k in keep], *made.fields])
    kinds = [_KINDS[f.dataType.simpleString() if not isinstance(f.dataType, T.MapType) else "map<string, string>"] for f in made.fields]

    def parse(text: str | None):
        try:
            document = json.loads(text) if text else None
        except ValueError:
            document = None
        return document if isinstance(document, dict) else {}

    def together(batch: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        same = [c.take(pa.array(at)) for c in batch.columns[: -len(json_cols)]]
        columns = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*same, *columns], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, texts in enumerate(zip(*batch.columns[-len(json_cols) :], strict=True)):
                for row in rows(*[parse(text.as_py()) for text in texts]):
                    at.append(i)
                    found.append(row)
                    if len(found) >= BATCH_ROWS:
                        yield together(batch, at, found)
                        at, found = [], []
            if found:
                yield together(batch, at, found)

    return df.select(*keep, *json_cols).mapInArrow(run, schema)


def compare_documents(base: DataFrame, head: DataFrame, json_col: str, keep: list[str], follow_refs: bool = False) -> DataFrame:
    """(*keep, impact, area, location, summary): what changed between two versions of the documents that share ``keep``.

    Operations that both have: bodies, responses, media types and their schemas; and the components. What a request adds as
    required breaks, what a response loses breaks, for components both do. Two schemas of different signature differ; where
    only one is an object, nothing below them is compared. Properties of one side alone are added or removed with all below.

    Pairs of nodes descend together, level after level. Both versions of a document meet once and are compared in one call if neither
    is longer than WHOLE_CHARS; of others each level is written and joins the pairs with either side's nodes, which were
    read once. With ``follow_refs`` a pair of local references leads to the pair of components that they
    name, under the rules of where it began; each pair of nodes is compared once under an area, at the first location that
    reaches it (of one level the smallest), so cycles end. Without, a reference is compared by its name alone. ``keep`` must
    not be null or repeat; a document that one side lacks counts as empty there. Nodes are merged, never broadcast: written
    tables of like documents are a small part of the rows they hold, so their size says nothing.
    """
    work = Workspace(base.sparkSession, "schemas")
    was, now = (df.select(*keep, F.col(json_col).alias(name)) for df, name in ((base, "__was"), (head, "__now")))
    too_long = lambda *texts: F.greatest(F.lit(0), *[F.length(text) for text in texts]) > WHOLE_CHARS
    met = was.join(now.hint("merge"), keep, "full_outer")
    whole = read_documents(met.where(~too_long("__was", "__now")), ["__was", "__now"], keep, _FOUND, lambda a, b: _differences(a, b, follow_refs))
    rare = any(not df.where(too_long(df.columns[-1])).isEmpty() for df in (was, now))
    met = work.save(met.where(too_long("__was", "__now")) if rare else met.limit(0), "long")

    sides = {}
    for side, text in (("left", "__was"), ("right", "__now")):
        parts = work.save(read_documents(met, [text], keep, _PART, _parts), f"{side}_parts")
        nodes = work.save(read_documents(met, [text], keep, _NODE, _nodes), f"{side}_nodes")
        sides[side] = parts, nodes.select(*keep, *[F.col(c).alias(f"{side}_{c}" if c != "pointer" else side) for c in nodes.columns if c not in keep])
    (old, left), (new, right) = sides["left"], sides["right"]

    id_cols = [*keep, "kind", "location"]
    a = old.select(*id_cols, F.col("area").alias("a0"), F.col("parent").alias("p0"), F.col("value").alias("v0"), F.col("pointer").alias("left"), F.lit(True).alias("had"))
    b = new.select(*id_cols, F.col("area").alias("a1"), F.col("parent").alias("p1"), F.col("value").alias("v1"), F.col("pointer").alias("right"), F.lit(True).alias("has"))
    parts = work.save(a.join(b, id_cols, "full_outer").select(*id_cols, F.coalesce("a0", "a1").alias("area"), F.coalesce("p0", "p1").alias("parent"), "v0", "v1", "left", "right", "had", "has"), "parts")
    shared = parts.where("kind in ('operation', 'response') and had and has").select(*keep, F.col("location").alias("parent"))
    judged = parts.where("area is not null and parent is not null").join(shared.unionAll(parts.where("kind = 'schema'").select(*keep, F.lit(None).cast("string").alias("parent"))).distinct().hint("merge"), [*keep, "parent"], "left_semi").select(*parts.columns)
    judged = judged.unionAll(parts.where("kind = 'schema'"))
    kind, text = F.col("kind"), lambda what: F.concat(F.col("kind"), F.lit(f" {what}"))
    body = F.when(F.col("had") & F.col("has") & (F.col("v0") != F.col("v1")), F.when(F.col("v1") == "true", F.struct(F.lit("breaking").alias("impact"), F.lit("request body became required").alias("summary"))).otherwise(F.struct(F.lit("changed").alias("impact"), F.lit("request body no longer required").alias("summary"))))
    change = (
        F.when(kind == "body", body)
        .when(F.col("had").isNull(), F.struct(F.lit("additive").alias("impact"), text("added").alias("summary")))
        .when(F.col("has").isNull(), F.struct(F.when(kind == "schema", "changed").otherwise("breaking").alias("impact"), text("removed").alias("summary")))
        .when((kind == "schema") & (F.col("left").isNull() | F.col("right").isNull()) & ~(F.col("left").isNull() & F.col("right").isNull() & F.col("v0").eqNullSafe(F.col("v1"))), F.struct(F.lit("breaking").alias("impact"), F.lit("schema changed").alias("summary")))
    )
    whats = ["impact", "area", "location", "summary"]
    found = [whole, judged.withColumn("f", change).where("f is not null").select(*keep, "f.impact", "area", "location", "f.summary")]

    pair_id = [*keep, "area", "left", "right"]
    frontier = work.save(judged.where("left is not null and right is not null").groupBy(*pair_id).agg(F.min("location").alias("location")), "level0")
    seen = frontier.select(*pair_id)
    for level in range(1, MAX_LEVELS + 1):
        if frontier.isEmpty():
            break
        met = work.save(frontier.join(left.hint("merge"), [*keep, "left"]).join(right.hint("merge"), [*keep, "right"]).withColumn("stops", (F.col("left_signature") != F.col("right_signature")) & (F.col("left_is_object") != F.col("right_is_object"))), f"pairs{level}")
        found.append(_pair_findings(met, keep).select(*keep, *whats))
        both = F.array_intersect(F.map_keys("left_children"), F.map_keys("right_children"))
        on = met.where("not stops")
        below = on.select(*keep, "area", "location", "left_children", "right_children", F.explode(both).alias("step"))
        below = below.select(*keep, "area", F.try_element_at("left_children", F.col("step")).alias("left"), F.try_element_at("right_children", F.col("step")).alias("right"), F.concat("location", "step").alias("location"))
        if follow_refs:
            below = below.unionAll(on.where("left_target is not null and right_target is not null").select(*keep, "area", F.col("left_target").alias("left"), F.col("right_target").alias("right"), "location"))
        fresh = below.groupBy(*pair_id).agg(F.min("location").alias("location"))
        if follow_refs:  # a tree never comes back to a pair
            fresh = fresh.join(seen.hint("merge"), pair_id, "left_anti")
        frontier = work.save(fresh.select(*pair_id, "location"), f"level{level}")
        seen = seen.unionAll(frontier.select(*pair_id))
    else:
        raise RuntimeError(f"schemas nest deeper than {MAX_LEVELS} levels")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _pair_findings(met: DataFrame, keep: list[str]) -> DataFrame:
    """What each pair of nodes itself tells: its signature, properties of one side, and what became or is no longer required."""
    breaks = lambda i: F.col("area").isin(*[area for area, rules in RULES.items() if rules[i]])
    finding = lambda impact, place, summary: F.struct(impact.alias("impact"), place.alias("location"), F.lit(summary).alias("summary"))
    names = lambda side: F.transform(F.filter(F.map_keys(f"{side}_children"), lambda k: k.startswith(".")), lambda k: F.substring(k, F.lit(2), F.length(k)))
    below = lambda name: F.concat(F.col("location"), F.lit("."), name)
    olds, news, was, now = names("left"), names("right"), F.col("left_required"), F.col("right_required")
    same = F.array_intersect(olds, news)

    def added(name):
        return F.when(F.array_contains(now, name) & breaks(0), finding(F.lit("breaking"), below(name), "required property added")).otherwise(finding(F.lit("additive"), below(name), "optional property added"))

    inside = F.concat(
        F.transform(F.array_except(news, olds), added),
        F.transform(F.array_except(olds, news), lambda n: finding(F.when(breaks(1), "breaking").otherwise("changed"), below(n), "property removed")),
        F.transform(F.array_intersect(F.array_except(now, was), same), lambda n: finding(F.lit("breaking"), below(n), "property became required")),
        F.transform(F.array_except(was, now), lambda n: finding(F.lit("changed"), below(n), "property no longer required")),
    )
    none = F.filter(inside, lambda x: F.lit(False))
    own = F.when(F.col("left_signature") != F.col("right_signature"), F.array(finding(F.lit("breaking"), F.col("location"), "schema changed"))).otherwise(none)
    return met.select(*keep, "area", F.explode(F.concat(own, F.when(F.col("stops"), none).otherwise(inside))).alias("f")).select(*keep, "area", "f.*")
