"""Claims derived from the nodes of OpenAPI documents, over one or two hops of local references, and their verification."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.json_text import pointer_escape
from attestor.operators.openapi import METHODS
from attestor.operators.schema_graph import read_documents
from attestor.session import Workspace

#: Places of a document that derivations read: operations, responses, schema references, component schemas and what stands below their properties.
READ = r"^/paths/[^/]+/[^/]+$|^/paths/[^/]+/[^/]+/responses/[^/]+(/content/[^/]+/schema/\$ref)?$|^/paths/[^/]+/[^/]+/requestBody/content/[^/]+/schema/\$ref$|^/components/schemas/[^/]+(/properties/.+)?$"
_SCHEMA, _PROPERTY = r"^/components/schemas/[^/]+$", r"^/components/schemas/[^/]+/properties/[^/]+$"
_REF = r"^/components/schemas/[^/]+/properties/[^/]+/(items/)?\$ref$"
_LOCAL = "#/components/schemas/"
#: Characters of nodes that are sent on at once.
BATCH_CHARS = 4_000_000
#: Pointers of which a worker remembers whether they are wanted, as like documents share them.
KNOWN_POINTERS = 65_536
#: Derivations that are checked by their result alone.
PLAIN = ["canonical_json", "normalize_boolean_token", "unicode_nfc"]
#: Derivations by one, and by two, references given as context, in order.
ONE_HOP = [
    "openapi_request_body_ref_property_name_from_fragments", "openapi_request_body_ref_property_required_from_fragments", "openapi_schema_ref_property_name_from_fragments",
    "openapi_schema_ref_property_type_from_fragments", "openapi_schema_ref_property_required_from_fragments",
]
TWO_HOPS = [f"openapi_schema_two_hop_ref_property_{what}_from_fragments" for what in ("name", "type", "required")]
#: Derivations from one place alone.
NO_HOP = [
    "openapi_method_from_pointer", "openapi_path_from_pointer", "openapi_response_status_from_pointer", "openapi_schema_name_from_ref", "openapi_request_schema_name_from_ref",
    "openapi_request_body_property_name_from_pointer", "openapi_request_body_property_required_from_schema_pointer", "openapi_schema_name_from_pointer",
    "openapi_schema_property_name_from_pointer", "openapi_schema_property_type_from_pointer", "openapi_schema_property_required_from_schema_pointer",
]

_STATUS = re.compile(r"default|[1-5]([0-9]{2}|XX)")
_BAD_ESCAPE = re.compile("~(?![01])")
_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def json_nodes(df: DataFrame, json_col: str, keep: list[str], where: str = READ) -> DataFrame:
    """(*keep, pointer, value) of the nodes, inner ones included, of a JSON column whose pointer matches ``where``; values are canonical JSON.

    Documents are read one by one; broken JSON and null give no nodes. Without limits in ``where`` a node is written once for each of its ancestors.
    """
    schema = T.StructType([*[f for f in df.schema.fields if f.name in keep], T.StructField("pointer", T.StringType()), T.StructField("value", T.StringType())])
    names = [f.name for f in schema.fields[:-2]]

    def nodes(text: str | None, wanted: Callable[[str], object]) -> Iterator[tuple[str, str]]:
        try:
            todo = [("", json.loads(text))] if text else []
        except ValueError:
            return
        while todo:
            at, node = todo.pop()
            if wanted(at):
                yield at, _encode(node)
            if isinstance(node, dict):
                todo += [(f"{at}/{k if '~' not in k and '/' not in k else k.replace('~', '~0').replace('/', '~1')}", v) for k, v in node.items()]
            elif isinstance(node, list):
                todo += [(f"{at}/{i}", v) for i, v in enumerate(node)]

    def together(batch: pa.RecordBatch, at: list[int], found: list[tuple[str, str]]) -> pa.RecordBatch:
        same = [c.take(pa.array(at)) for c in batch.columns[:-1]]
        return pa.RecordBatch.from_arrays([*same, pa.array([p for p, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(where)
        wanted = lru_cache(KNOWN_POINTERS)(lambda at: pattern.search(at) is not None)
        for batch in batches:
            at, found, size = [], [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for node in nodes(text.as_py(), wanted):
                    at.append(i)
                    found.append(node)
                    size += len(node[0]) + len(node[1])
                    if size >= BATCH_CHARS:
                        yield together(batch, at, found)
                        at, found, size = [], [], 0
            if found:
                yield together(batch, at, found)

    return df.select(*names, json_col).mapInArrow(run, schema)


def _unescaped(segment: Column) -> Column:
    """The raw segment; null if a tilde starts no escape."""
    return F.when(~segment.contains("~"), segment).when(~segment.rlike("~(?![01])"), F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def _text(value: Column) -> Column:
    """The string that a JSON value is, else null."""
    return F.when(value.startswith('"'), F.try_variant_get(F.try_parse_json(value), "$", "string"))


def _target(value: Column) -> Column:
    """The component that a local reference names."""
    name = F.substring_index(_text(value), _LOCAL, -1)
    return F.when(_text(value).startswith(_LOCAL) & (name != "") & ~name.contains("/"), _unescaped(name))


def input_digest(pointer: Column, value: Column) -> Column:
    """Digest of a fragment as a derivation's input: its locator and its value."""
    quoted = F.to_json(F.array(pointer))
    return F.sha2(F.concat(F.lit('{"locator":{"kind":"json_pointer","pointer":'), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit('},"semantic_value":'), value, F.lit("}")), 256)


def _field_path(tail: Column) -> Column:
    """``.name`` and ``[]`` of the pointer segments below a property, in order; null if they are not properties and items alone."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("named"), F.lit(True).alias("ok"))

    def step(acc: Column, s: Column) -> Column:
        name = _unescaped(s)
        return (
            F.when(acc["named"], F.struct(F.concat(acc["out"], F.lit("."), F.coalesce(name, F.lit(""))).alias("out"), F.lit(False).alias("named"), (acc["ok"] & (F.coalesce(name, F.lit("")) != "")).alias("ok")))
            .when(s == "items", F.struct(F.concat(acc["out"], F.lit("[]")).alias("out"), F.lit(False).alias("named"), acc["ok"].alias("ok")))
            .otherwise(F.struct(acc["out"].alias("out"), F.lit(True).alias("named"), (acc["ok"] & (s == "properties")).alias("ok")))
        )

    return F.when(F.size(tail) == 0, "").otherwise(F.aggregate(tail, start, step, lambda acc: F.when(acc["ok"] & ~acc["named"], acc["out"])))


def _quoted(s: Column) -> Column:
    """A string as JSON; null stays null."""
    inside = F.to_json(F.array(s))
    return F.when(s.rlike(r"^[ !#-\[\]-~]*$"), F.concat(F.lit('"'), s, F.lit('"'))).when(s.isNotNull(), F.substring(inside, F.lit(2), F.length(inside) - 2))


def _path(parts: str, field: Column, what: str) -> Column:
    return F.concat(F.lit(f"/{parts}/"), pointer_escape(field), F.lit(f"/{what}"))


def _kids(node) -> Iterator[tuple[str, object]]:
    """Members of an object and elements of an array, by the keys that pointers have for them; none is empty."""
    return ((k, v) for k, v in (node.items() if isinstance(node, dict) else ((str(i), v) for i, v in enumerate(node)) if isinstance(node, list) else ()) if k)


def _at(node, *keys: str):
    for k in keys:
        node = node.get(k) if isinstance(node, dict) else None
    return node


def _named(ref) -> str | None:
    """The component that a local reference names."""
    name = ref.rsplit(_LOCAL, 1)[-1] if isinstance(ref, str) and ref.startswith(_LOCAL) else ""
    return name.replace("~1", "/").replace("~0", "~") if name and "/" not in name and not _BAD_ESCAPE.search(name) else None


def _type(node) -> tuple[str | None, bool, str]:
    """(type, whether it is an object that states no odd one, array mark) of a schema."""
    kind = node.get("type") if isinstance(node, dict) else None
    return (kind, True, "[]" if kind == "array" else "") if isinstance(kind, str) else (None, isinstance(node, dict) and kind is None, "")


def _fields(node, rest: str) -> Iterator[tuple[str, object]]:
    """(path below the property, node) of a property and all that stands below it by properties and items."""
    todo = [(rest, node)]
    while todo:
        rest, node = todo.pop()
        yield rest, node
        if isinstance(node, dict):
            if "items" in node:
                todo.append((rest + "[]", node["items"]))
            if "properties" in node:
                todo += [(f"{rest}.{name}", below) for name, below in _kids(node["properties"])]


def _claims(document: dict) -> Iterator[tuple[str, str | None, str, str]]:
    """(derivation, scope, claim_path, value) of every claim that a document allows to derive."""
    escape = lambda s: s.replace("~", "~0").replace("/", "~1") if "~" in s or "/" in s else s
    for path, item in _kids(document.get("paths")):
        for method, op in _kids(item) if path.startswith("/") else ():
            if method not in METHODS:
                continue
            yield "openapi_path_from_pointer", None, "/path", _encode(path)
            yield "openapi_method_from_pointer", None, "/method", _encode(method.upper())
            for status, answer in _kids(_at(op, "responses")):
                if _STATUS.fullmatch(status):
                    yield "openapi_response_status_from_pointer", None, f"/responses/{status}/status_code", _encode(status)
                    for _, content in _kids(_at(answer, "content")):
                        if name := _named(_at(content, "schema", "$ref")):
                            yield "openapi_schema_name_from_ref", None, f"/responses/{status}/schema_ref", _encode(name)
            for _, content in _kids(_at(op, "requestBody", "content")):
                if name := _named(_at(content, "schema", "$ref")):
                    yield "openapi_request_schema_name_from_ref", None, "/request_schema_ref", _encode(name)

    direct: dict[str, list[tuple[str, str | None, bool, bool]]] = {}
    members: dict[str, list[tuple[str, str, bool]]] = {}
    hops: list[tuple[str, str, bool, str]] = []
    for schema, node in _kids(_at(document, "components", "schemas")):
        yield NO_HOP[7], schema, "/name", _encode(schema)
        own, properties, listed = direct.setdefault(schema, []), _at(node, "properties"), node.get("required", []) if isinstance(node, dict) else None
        for name, prop in _kids(properties):
            kind, stated, mark = _type(prop)
            own.append((name + mark, None if kind is None else _encode(kind), stated, bool(mark) or not name.endswith("[]")))
            for rest, below in _fields(prop, ""):
                kind, stated, mark = _type(below)
                field = name + mark + rest
                yield NO_HOP[5], schema, f"/parameters/body/{escape(field)}/name", _encode(field)
                if stated:
                    field = name + rest + mark
                    yield NO_HOP[8], schema, f"/fields/{escape(field)}/name", _encode(field)
                    if kind is not None:
                        yield NO_HOP[9], schema, f"/fields/{escape(field)}/type", _encode(kind)
            if isinstance(prop, dict):
                hops += [(schema, name, array, to) for array, ref in ((False, prop.get("$ref")), (True, _at(prop, "items", "$ref"))) if (to := _named(ref))]
        if isinstance(listed, list) and isinstance(properties, dict) and all(isinstance(x, str) for x in listed):
            held, needs = members.setdefault(schema, []), set(listed)
            for name, prop in properties.items():
                mark = _type(prop)[2]
                if isinstance(prop, dict) and (mark or name and not name.endswith("[]")):
                    field, needed, plain = name + mark, "true" if name in needs else "false", "." not in name
                    held.append((field, needed, plain))
                    if plain:
                        yield NO_HOP[6], schema, f"/parameters/body/{escape(field)}/required", needed
                    yield NO_HOP[10], schema, f"/fields/{escape(field)}/required", needed

    above: dict[str, list[tuple[str, str]]] = {}
    for schema, name, array, to in hops:
        if array:
            above.setdefault(to, []).append((schema, name))
    for schema, name, array, to in hops:
        prefix = f"{name}[]." if array else f"{name}."
        for own, kind, stated, _ in direct.get(to, ()):
            field = prefix + own
            place, text = escape(field), _encode(field)
            if array:
                yield ONE_HOP[0], schema, f"/parameters/body/{place}/name", text
            if stated:
                yield ONE_HOP[2], schema, f"/fields/{place}/name", text
                if kind is not None:
                    yield ONE_HOP[3], schema, f"/fields/{place}/type", kind
        for own, needed, plain in members.get(to, ()) if "." not in name else ():
            if plain:
                place = escape(prefix + own)
                if array:
                    yield ONE_HOP[1], schema, f"/parameters/body/{place}/required", needed
                yield ONE_HOP[4], schema, f"/fields/{place}/required", needed
        for top, first in above.get(schema, ()) if array else ():
            far = f"{first}[].{prefix}"
            for own, kind, stated, fits in direct.get(to, ()):
                if stated and fits:
                    place = escape(far + own)
                    yield TWO_HOPS[0], top, f"/fields/{place}/name", _encode(far + own)
                    if kind is not None:
                        yield TWO_HOPS[1], top, f"/fields/{place}/type", kind
            for own, needed, _ in members.get(to, ()):
                yield TWO_HOPS[2], top, f"/fields/{escape(far + own)}/required", needed


def document_claims(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """(*keep, derivation, scope, claim_path, value): the claims of derivable_claims() read from whole documents, without their inputs.

    A document holds all that its claims are derived from, so each is read in one call, without nodes, joins or shuffles.
    Verification needs inputs and digests, which derivable_claims() gives.
    """
    return read_documents(df, [json_col], keep, "derivation string, scope string, claim_path string, value string", _claims)


def derivable_claims(nodes: DataFrame, doc: str = "document") -> DataFrame:
    """Every claim that the documents' nodes (``doc``, pointer, value) allow to derive, without any proposal.

    (doc, derivation, scope, claim_path, value, inputs, digests): ``scope`` is the schema that the claim is about, or the operation's request
    schema for parameters of a body; ``value`` canonical JSON; ``inputs`` the pointer of the node and of the references that lead
    to it, in order, and ``digests`` their digests. References are followed by joins of a property's ``$ref`` with the
    component that it names, once or twice and never a third time, so cycles end by themselves.

    A body's field takes the array mark of its own type before the path below it, a schema's field after it. A claim
    that a property is required is about direct properties only; behind a reference, of names without a dot.

    The nodes are written once, so that documents are read once for all derivations. A node, or a reference with what it leads
    to, gives all its claims at once: references meet each other in one join, and what they lead to in another. They are
    merged, never broadcast: tables of like documents are a small part of the rows they hold.
    """
    seg = F.split("pointer", "/")
    work = Workspace(nodes.sparkSession, "derivations")
    rows = work.save(nodes.select(F.col(doc).alias("doc"), "pointer", "value"), "nodes").withColumn("digest", input_digest(F.col("pointer"), F.col("value")))
    part = lambda i: _unescaped(F.get(seg, F.lit(i)))
    none = F.lit(None).cast("string")

    def claims(df: DataFrame, *each: tuple[str, Column, Column, Column], hops: int = 0) -> DataFrame:
        """The (derivation, scope, claim_path, value) of ``each`` row that have both path and value, with the row's fragments as inputs."""
        made = F.explode(F.array(*[F.struct(F.lit(name).alias("derivation"), scope.alias("scope"), path.alias("claim_path"), value.alias("value")) for name, scope, path, value in each])).alias("claim")
        kinds = ["pointer", "digest"]
        inputs = [F.array(*([c] + ([f"r1_{c}", f"r2_{c}"] if hops else []))) for c in kinds]
        inputs = [F.filter(c, lambda x: x.isNotNull()) if hops else c for c in inputs]
        out = df.select("doc", made, *[c for k in kinds for c in ([k] + ([f"r1_{k}", f"r2_{k}"] if hops else []))]).where("claim.claim_path is not null and claim.value is not null")
        return out.select("doc", "claim.*", inputs[0].alias("inputs"), inputs[1].alias("digests"))

    paths = rows.where(F.col("pointer").startswith("/paths/") & F.get(seg, F.lit(3)).isin(METHODS) & part(2).startswith("/"))
    status = F.when(F.col("pointer").rlike(r"^/paths/[^/]+/[^/]+/responses/(default|[1-5]([0-9]{2}|XX))(/|$)"), F.get(seg, F.lit(5)))
    media = lambda i: F.coalesce(part(i), F.lit("")) != ""
    paths = paths.select("doc", "pointer", "digest", F.size(seg).alias("n"), _quoted(part(2)).alias("path"), _quoted(F.upper(F.get(seg, F.lit(3)))).alias("method"), status.alias("status"), F.when(F.size(seg) >= 9, _quoted(_target(F.col("value")))).alias("target"), media(7).alias("answer_media"), media(6).alias("request_media"))
    at = lambda n, value: F.when(F.col("n") == n, value)
    answer = lambda what: F.concat(F.lit("/responses/"), "status", F.lit(f"/{what}"))
    out = [claims(
        paths,
        ("openapi_path_from_pointer", none, F.lit("/path"), at(4, F.col("path"))),
        ("openapi_method_from_pointer", none, F.lit("/method"), at(4, F.col("method"))),
        ("openapi_response_status_from_pointer", none, answer("status_code"), at(6, _quoted(F.col("status")))),
        ("openapi_schema_name_from_ref", none, answer("schema_ref"), at(10, F.when(F.col("answer_media"), F.col("target")))),
        ("openapi_request_schema_name_from_ref", none, F.lit("/request_schema_ref"), at(9, F.when(F.col("request_media"), F.col("target")))),
    )]

    variant = F.when(F.col("value").startswith("{"), F.try_parse_json("value"))
    kind = lambda v: F.schema_of_variant(v)
    type_of = F.try_variant_get("variant", "$.type", "variant")
    own_type = F.when(kind(F.col("type_of")) == "STRING", F.try_variant_get("type_of", "$", "string"))
    odd_type = F.coalesce(F.col("type_of").isNotNull() & ~kind(F.col("type_of")).isin("STRING", "VOID"), F.lit(False))
    below = rows.where(F.col("pointer").rlike(r"^/components/schemas/[^/]+/properties/"))
    below = below.select("*", part(3).alias("schema"), part(5).alias("name"), F.slice(seg, F.lit(7), F.greatest(F.size(seg) - 6, F.lit(0))).alias("tail"), F.col("value").startswith("{").alias("is_object"), variant.alias("variant"))
    below = below.where("schema != '' and name != ''").withColumn("rest", _field_path(F.col("tail"))).withColumn("type_of", type_of)
    below = below.select("doc", "pointer", "digest", "schema", "name", "rest", own_type.alias("type"), (F.col("is_object") & ~odd_type).alias("stated")).withColumn("mark", F.when(F.col("type") == "array", "[]").otherwise(""))
    body_field, schema_field = F.concat("name", "mark", "rest"), F.concat("name", "rest", "mark")
    fields = below.where("rest is not null").select("doc", "pointer", "digest", "schema", "type", "stated", body_field.alias("body_field"), schema_field.alias("schema_field"))
    stated = lambda value: F.when(F.col("stated"), value)
    out.append(claims(
        fields,
        (NO_HOP[5], F.col("schema"), _path("parameters/body", F.col("body_field"), "name"), _quoted(F.col("body_field"))),
        (NO_HOP[8], F.col("schema"), _path("fields", F.col("schema_field"), "name"), stated(_quoted(F.col("schema_field")))),
        (NO_HOP[9], F.col("schema"), _path("fields", F.col("schema_field"), "type"), stated(_quoted(F.col("type")))),
    ))

    schemas = rows.where(F.col("pointer").rlike(_SCHEMA)).select("*", part(3).alias("schema")).where("schema != ''")
    names = F.try_variant_get("variant", "$.required", "array<variant>")
    raw = F.try_variant_get("variant", "$.required", "variant")
    listed = F.when(raw.isNull(), F.array().cast("array<string>")).when(F.forall(names, lambda x: F.schema_of_variant(x) == "STRING"), F.transform(names, lambda x: F.try_variant_get(x, "$", "string")))
    children = F.explode(F.try_variant_get("variant", "$.properties", "map<string, variant>"))
    members = schemas.where(F.col("value").startswith("{")).withColumn("variant", variant).withColumn("listed", listed).where("listed is not null").select("doc", "pointer", "digest", "schema", "listed", children.alias("name", "child"))
    child_type = F.when(F.schema_of_variant(F.try_variant_get("child", "$.type", "variant")) == "STRING", F.try_variant_get("child", "$.type", "string"))
    members = members.where(F.schema_of_variant("child").startswith("OBJECT")).withColumn("mark", F.when(child_type == "array", "[]").otherwise(""))
    members = members.where((F.col("mark") == "[]") | ~F.col("name").endswith("[]")).where("concat(name, mark) != ''").withColumn("needed", F.array_contains("listed", F.col("name")).cast("string"))
    members = members.select("doc", "pointer", "digest", "schema", "name", "mark", "needed", (~F.col("name").contains(".")).alias("is_plain"))
    out.append(claims(schemas, (NO_HOP[7], F.col("schema"), F.lit("/name"), _quoted(F.col("schema")))))
    out.append(claims(
        members.withColumn("own", F.concat("name", "mark")),
        (NO_HOP[6], F.col("schema"), _path("parameters/body", F.col("own"), "required"), F.when(F.col("is_plain"), F.col("needed"))),
        (NO_HOP[10], F.col("schema"), _path("fields", F.col("own"), "required"), F.col("needed")),
    ))

    def hop(n: int) -> DataFrame:
        """References of properties: the owner, the property with its array mark, and the component that it leads to."""
        refs = rows.where(F.col("pointer").rlike(_REF)).select("doc", F.col("pointer").alias(f"r{n}_pointer"), F.col("digest").alias(f"r{n}_digest"), part(3).alias(f"owner{n}"), part(5).alias(f"from{n}"), (F.size(seg) == 8).alias(f"array{n}"), _target(F.col("value")).alias(f"to{n}"))
        return refs.where(f"owner{n} != '' and from{n} != '' and to{n} is not null")

    first = hop(1)
    chain = first.where("array1").withColumn("owner2", F.col("to1")).join(hop(2).where("array2").hint("merge"), ["doc", "owner2"])
    way = ["doc", "schema", "owner", "prefix", "by_array", "two", "dotted", "r1_pointer", "r1_digest", "r2_pointer", "r2_digest"]
    one = first.select("doc", F.col("to1").alias("schema"), F.col("owner1").alias("owner"), F.concat("from1", F.when(F.col("array1"), "[].").otherwise(".")).alias("prefix"), F.col("array1").alias("by_array"), F.lit(False).alias("two"), F.col("from1").contains(".").alias("dotted"), "r1_pointer", "r1_digest", none.alias("r2_pointer"), none.alias("r2_digest"))
    two = chain.select("doc", F.col("to2").alias("schema"), F.col("owner1").alias("owner"), F.concat("from1", F.lit("[]."), "from2", F.lit("[].")).alias("prefix"), F.lit(True).alias("by_array"), F.lit(True).alias("two"), F.lit(False).alias("dotted"), "r1_pointer", "r1_digest", "r2_pointer", "r2_digest")
    direct = below.where(F.col("pointer").rlike(_PROPERTY)).select("doc", "schema", "pointer", "digest", "name", "mark", "type", "stated", F.lit(False).alias("member"), none.alias("needed"), F.lit(None).cast("boolean").alias("is_plain"))
    held = members.select("doc", "schema", "pointer", "digest", "name", "mark", none.alias("type"), F.lit(False).alias("stated"), F.lit(True).alias("member"), "needed", "is_plain")
    met = one.select(*way).unionAll(two.select(*way)).join(direct.unionAll(held).hint("merge"), ["doc", "schema"])
    flag = lambda c: F.expr(c)
    met = met.select("*", F.concat("prefix", "name", "mark").alias("field"), ((F.col("mark") == "[]") | ~F.col("name").endswith("[]")).alias("fits"))
    met = met.select("*", _quoted(F.col("field")).alias("quoted_field"), _quoted(F.col("type")).alias("quoted_type"))
    field, about, inside = F.col("field"), F.col("owner"), "member and not two and is_plain and not dotted"
    out.append(claims(
        met,
        (ONE_HOP[0], about, _path("parameters/body", field, "name"), F.when(flag("not member and not two and by_array"), F.col("quoted_field"))),
        (ONE_HOP[1], about, _path("parameters/body", field, "required"), F.when(flag(f"{inside} and by_array"), F.col("needed"))),
        (ONE_HOP[2], about, _path("fields", field, "name"), F.when(flag("stated and not two"), F.col("quoted_field"))),
        (ONE_HOP[3], about, _path("fields", field, "type"), F.when(flag("stated and not two"), F.col("quoted_type"))),
        (ONE_HOP[4], about, _path("fields", field, "required"), F.when(flag(inside), F.col("needed"))),
        (TWO_HOPS[0], about, _path("fields", field, "name"), F.when(flag("stated and two and fits"), F.col("quoted_field"))),
        (TWO_HOPS[1], about, _path("fields", field, "type"), F.when(flag("stated and two and fits"), F.col("quoted_type"))),
        (TWO_HOPS[2], about, _path("fields", field, "required"), F.when(flag("member and two"), F.col("needed"))),
        hops=1,
    ))
    every = out[0]
    for more in out[1:]:
        every = every.unionAll(more)
    return every.withColumnRenamed("doc", doc)


def verify_derivations(supports: DataFrame, derivable: DataFrame, doc: str = "document") -> DataFrame:
    """``supports`` with ``reason``: why the derivation that each proposes holds or not.

    A support has ``doc``, n_steps, derivation, version, scope (schema of the claim, or the operation's request schema), claim_path, claim_value
    (canonical JSON), inputs (the pointer of its fragment, then of its context), context_docs (the documents of the context),
    structured (whether it is verified by field path and the fragment has a role), input_digests and output_digest. The first check that
    fails gives the reason. What is derived comes from the documents themselves (derivable_claims), never from the proposal; a third reference
    is refused.
    """
    hops = F.when(F.col("derivation").isin(ONE_HOP), 1).when(F.col("derivation").isin(TWO_HOPS), 2).otherwise(0)
    given = F.size("inputs") - 1
    found = derivable.select(F.col(doc).alias("d"), F.col("derivation").alias("by"), F.col("scope").alias("about"), F.col("inputs").alias("from"), F.col("claim_path").alias("path"), F.col("value").alias("derived"), F.col("digests").alias("true_digests"))
    free = F.col("by").isin(*[n for n in (*NO_HOP, *ONE_HOP) if "required" not in n])  # others read the claim path as an input
    same = (F.col(doc) == F.col("d")) & (F.col("derivation") == F.col("by")) & (F.col("inputs") == F.col("from")) & (F.col("about").isNull() | (F.col("scope") == F.col("about"))) & (free | (F.col("claim_path") == F.col("path")))
    met = supports.join(found, same, "left")
    digest = lambda c: F.sha2(c, 256)
    by_result = F.when(F.col("output_digest") != digest(F.col("claim_value")), "DERIVATION_OUTPUT_MISMATCH").otherwise("DERIVATION_ALLOWED")
    pointer = (
        F.when(F.col("n_steps") != 1, "DERIVATION_CHAIN_INVALID")
        .when((hops == 0) & (given > 0), "DERIVATION_CONTEXT_INVALID")
        .when(F.exists("context_docs", lambda c: c != F.col(doc)), "DERIVATION_CONTEXT_ARTIFACT_MISMATCH")
        .when(given != hops, "DERIVATION_CONTEXT_INVALID")
        .when(F.col("path").isNull() & (F.col("derivation") == NO_HOP[2]), "DERIVATION_CLAIM_PATH_MISMATCH")
        .when(F.col("path").isNull(), "DERIVATION_INAPPLICABLE")
        .when(F.col("claim_path") != F.col("path"), "DERIVATION_CLAIM_PATH_MISMATCH")
        .when(~F.col("structured"), "DERIVATION_INAPPLICABLE")
        .when(F.col("input_digests") != F.col("true_digests"), "DERIVATION_INPUT_MISMATCH")
        .when(F.col("output_digest") != digest(F.col("derived")), "DERIVATION_OUTPUT_MISMATCH")
        .when(F.col("derived") != F.col("claim_value"), "DERIVATION_VALUE_MISMATCH")
        .otherwise("OPENAPI_POINTER_DERIVATION_MATCH")
    )
    reason = (
        F.when(F.col("n_steps") == 0, "DERIVATION_STEPS_REQUIRED")
        .when((F.col("version") != "1") | ~F.col("derivation").isin(*PLAIN, *NO_HOP, *ONE_HOP, *TWO_HOPS), "DERIVATION_NOT_ALLOWED")
        .when(F.col("derivation").isin(*PLAIN), by_result)
        .otherwise(pointer)
    )
    return met.select(*supports.columns, reason.alias("reason"))
