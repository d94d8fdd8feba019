"""Documents written out from contract tables: OpenAPI as canonical JSON, GraphQL as schema text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.json_text import pointer_escape
from attestor.operators.openapi import MISSING, STATUS_KEY
from attestor.session import Workspace

_NAME = r"^[A-Za-z0-9._-]+$"
_STEPS = "array<string>"
#: Characters and rows that are sent on at once.
BATCH_CHARS, BATCH_ROWS = 4_000_000, 10_000
#: What passes make, apart from keys as they came.
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), _STEPS: pa.list_(pa.string())}


def quoted(text: Column) -> Column:
    """A string as JSON."""
    inside = F.to_json(F.array(text))
    plain = text.rlike(r"^[ !#-\[\]-~]*$")  # nothing to escape
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.substring(inside, F.lit(2), F.length(inside) - 2))


def key(name: Column | str) -> Column:
    """A step to the member of an object."""
    return F.concat(F.lit("k"), F.lit(name) if isinstance(name, str) else name)


def place(number: Column) -> Column:
    """A step to the element of an array; elements stand by number."""
    return F.concat(F.lit("i"), F.lpad(number.cast("string"), 12, "0"))


#: The step of a row that says that its parent exists, whatever it holds: its value is {} or [].
HERE = ""


@lru_cache(65_536)
def _name(step: str) -> str:
    """The name of a member as JSON, escaped as quoted() does."""
    text = json.dumps(step[1:], ensure_ascii=False)
    return re.sub(r"\\(u[0-9a-f]{4}|.)", lambda m: "\\u" + m[1][1:].upper() if len(m[1]) == 5 else m[0], text) if "\\u" in text else text


class _Tree:
    """Leaves of one document, put in by path and folded at the end."""

    def __init__(self):
        self.leaf: str | None = None
        self.root: tuple[dict, dict] | None = None

    def put(self, path: list[str | None], value: str | None) -> None:
        if not path:
            self.leaf = _greater(self.leaf, value)
            return
        if self.root is None:
            self.root = {}, {}
        inner, leaves = self.root
        for step in path[:-1]:
            if step is None:
                return
            found = inner.get(step)
            if found is None:
                found = inner[step] = {}, {}
            inner, leaves = found
        step = path[-1]
        if step is not None:
            leaves[step] = _greater(leaves.get(step), value)

    def json(self) -> str | None:
        return _greater(self.leaf, None if self.root is None else _folded(self.root))


def _greater(a: str | None, b: str | None) -> str | None:
    return b if a is None else a if b is None else max(a, b)


def _folded(node: tuple[dict, dict]) -> str:
    inner, leaves = node
    texts = leaves | {step: _greater(leaves.get(step), _folded(below)) for step, below in inner.items()} if inner else leaves
    marker = texts.get(HERE)
    steps = sorted(s for s in texts if s != HERE)
    if marker == "{}" or marker is None and steps and steps[-1][0] == "k":
        return "{" + ",".join([f"{_name(s)}:{texts[s]}" for s in steps if texts[s] is not None]) + "}"
    return "[" + ",".join([texts[s] for s in steps if texts[s] is not None]) + "]"


def _by_key(df: DataFrame, keys: list[str], schema: T.StructType, start: Callable, end: Callable) -> DataFrame:
    """One pass over the rows of each key, which meet in one task: ``start()`` gives what takes each row, ``end(key, it)`` its rows of ``schema``."""
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    dealt = dealt.sortWithinPartitions(F.xxhash64(*keys), *keys) if len(keys) > 1 else dealt.sortWithinPartitions(*keys)  # most keys are told apart by one number
    others = [c for c in df.columns if c not in keys]

    def values(column: pa.Array) -> list:
        if pa.types.is_string(column.type):
            return column.to_numpy(zero_copy_only=False).tolist()
        if not pa.types.is_list(column.type):
            return column.to_pylist()
        flat, ends = values(column.flatten()), np.cumsum([0, *column.value_lengths().fill_null(0).to_numpy()]).tolist()
        return [flat[a:b] if there else None for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, it, made, chars, kinds = None, None, [], 0, None

        def together() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=schema.names)

        for batch in batches:
            if kinds is None:
                kinds = [_ARROW.get(f.dataType.simpleString()) or batch.schema.field(f.name).type for f in schema.fields]
            found = zip(*[values(batch.column(c)) for c in others], strict=True)
            for key, row in zip(zip(*[values(batch.column(k)) for k in keys], strict=True), found, strict=True):
                if it is None or key != now:
                    if it is not None:
                        for out in end(now, it):
                            made.append(out)
                            for x in out:
                                if type(x) is str:
                                    chars += len(x)
                        if made and (chars >= BATCH_CHARS or len(made) >= BATCH_ROWS):
                            yield together()
                            made, chars = [], 0
                    now, it = key, start()
                it(row)
        if it is not None:
            made += end(now, it)
        if made:
            yield together()

    return dealt.select(*keys, *others).mapInArrow(run, schema)


class _Document:
    """What _documents() takes of one document: leaves; rows without path are the places where it is asked for, or why it can't be written."""

    def __init__(self):
        self.tree, self.asked, self.error = _Tree(), 0, None

    def __call__(self, row: tuple) -> None:
        path, value = row
        if path is not None:
            self.tree.put(path, value)
        elif value is None:
            self.asked += 1
        elif self.error is None or value < self.error:
            self.error = value


def fold_json(rows: DataFrame, keep: list[str], work: Workspace | None = None) -> DataFrame:
    """(*keep, json): the tree whose leaves are ``rows`` (*keep, path, value), as JSON with sorted keys and no spaces.

    ``path`` is an array of steps made by key(), place() and HERE, ``value`` JSON. A document's leaves meet in one task, by one
    shuffle, and are folded in one pass. Of rows that repeat a step the greatest value stays. Rows without path
    are the whole document. With ``work`` the rows are written first, for such as are dear to make.
    """
    rows = rows.select(*keep, F.col("path").cast(_STEPS).alias("path"), "value").where("path is not null")
    rows = rows if work is None else work.save(rows, "leaves")
    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField("json", T.StringType())])
    return _by_key(rows, keep, schema, _Document, lambda key, it: [(*key, it.tree.json())])


def _rows(df: DataFrame, path: list[Column | str], value: Column, where: Column | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    return df.select("contract", F.array(*[F.lit(s) if isinstance(s, str) else s for s in path]).alias("path"), value.alias("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _reference(name: Column) -> Column:
    return quoted(F.concat(F.lit("#/components/schemas/"), pointer_escape(name)))


def _schema_rows(schemas: DataFrame, fields: DataFrame, at: list[Column | str]) -> list[DataFrame]:
    base, own = [*at, key(F.col("name"))], [*at, key(F.col("schema"))]
    prop = [*own, key("properties"), key(F.col("name"))]
    ref, kind = F.coalesce(F.col("schema_ref"), F.lit("")) != "", F.coalesce(F.col("type"), F.lit("")) != ""
    return [
        _rows(schemas, [*base, key("type")], F.lit('"object"')),
        _rows(schemas, [*base, key("properties"), HERE], F.lit("{}")),
        _rows(fields, [*prop, HERE], F.lit("{}")),
        _rows(fields, [*prop, key("$ref")], _reference(F.col("schema_ref")), ref),
        _rows(fields, [*prop, key("type")], quoted(F.col("type")), ~ref & kind),
        _rows(fields, [*own, key("required"), place(F.col("ord"))], quoted(F.col("name")), F.coalesce("required", F.lit(False))),
    ]


def _refusals(found: list[tuple[DataFrame, Column]]) -> DataFrame:
    """(contract, error): the least reason for which each refused contract can't be written."""
    rows = _union([df.select("contract", reason.alias("error")) for df, reason in found])
    return rows.groupBy("contract").agg(F.min("error").alias("error"))


def _repeats(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("contract", *columns).count().where("count > 1")


def _with_errors(contracts: DataFrame, content: DataFrame, errors: DataFrame) -> DataFrame:
    met = contracts.select("contract").join(content, "contract", "left").join(errors, "contract", "left")
    return met.select("contract", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")


def _operations(operations: DataFrame, parameters: DataFrame, responses: DataFrame) -> DataFrame:
    """(contract, path, value, repeated): each operation as JSON at its place, by one pass over its own row, its parameters and its responses."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    reference = lambda c: F.concat(F.lit('{"$ref":'), _reference(F.col(c)), F.lit("}"))
    content = lambda c: F.when(said(c), F.concat(F.lit('{"application/json":{"schema":'), reference(c), F.lit("}}")))
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    object_ = lambda *members: F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    needs = F.transform("security", lambda s: F.when(s.isNull(), "[]").otherwise(F.concat(F.lit("{"), quoted(s), F.lit(":[]}"))))
    listed = F.when(F.size("security") > 0, F.concat(F.lit("["), F.array_join(needs, ","), F.lit("]")))
    body = F.when(said("request_schema_ref"), F.concat(F.lit('{"content":'), content("request_schema_ref"), F.lit("}")))
    key = ["contract", "path", F.lower("method").alias("method")]
    none = F.lit(None).cast("string")
    own = operations.select(*key, F.lit("o").alias("kind"), none.alias("step"), none.alias("value"), body.alias("body"), listed.alias("needs"), F.when(said("summary"), quoted(F.col("summary"))).alias("summary"))
    parameter = object_(member("in", quoted(F.col("location"))), member("name", quoted(F.col("name"))), member("required", F.col("required").cast("string")), F.when(said("schema_ref"), member("schema", reference("schema_ref"))))
    asked = parameters.select(*key, F.lit("p"), place(F.col("ord")), parameter, none, none, none)
    answer = object_(member("content", content("schema_ref")), member("description", quoted(F.coalesce("description", F.lit("")))))
    told = responses.select(*key, F.lit("r"), F.col("status"), answer, none, none, none)

    schema = T.StructType([T.StructField("contract", own.schema["contract"].dataType), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("value", T.StringType()), T.StructField("repeated", T.BooleanType())])
    return _by_key(own.unionAll(asked).unionAll(told), ["contract", "path", "method"], schema, _Operation, lambda at, it: [it.leaf(*at)])


class _Operation:
    """What is said of one operation: its own rows, its parameters by place and its responses by status."""

    def __init__(self):
        self.own, self.body, self.needs, self.summary, self.asks, self.answers = 0, None, None, None, None, None

    def __call__(self, row: tuple) -> None:
        kind, step, value, body, needs, summary = row
        if kind == "o":
            self.own += 1
            self.body, self.needs, self.summary = _greater(self.body, body), _greater(self.needs, needs), _greater(self.summary, summary)
            return
        if kind == "p":
            parts = self.asks = {} if self.asks is None else self.asks
        else:
            parts = self.answers = {} if self.answers is None else self.answers
        if step is not None:
            parts[step] = _greater(parts.get(step), value)

    def leaf(self, contract, path: str | None, method: str | None) -> tuple:
        """Its place and text, and whether more than one operation stands there."""
        members = []
        if self.asks is not None:
            members.append('"parameters":[' + ",".join([self.asks[s] for s in sorted(self.asks)]) + "]")
        if self.body is not None:
            members.append('"requestBody":' + self.body)
        if self.own or self.answers is not None:
            told = self.answers or {}
            members.append('"responses":{' + ",".join([f"{_name('k' + s)}:{told[s]}" for s in sorted(told)]) + "}")
        if self.needs is not None:
            members.append('"security":' + self.needs)
        if self.summary is not None:
            members.append('"summary":' + self.summary)
        return contract, ["kpaths", None if path is None else "k" + path, None if method is None else "k" + method], "{" + ",".join(members) + "}", self.own > 1


def openapi_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """(contract, content, error): each contract as an OpenAPI 3.1 document, or why it can't be one.

    ``tables`` by name, all with ``contract``: contracts (title, version), environments (ord, name, servers), schemas (name), fields (schema, ord,
    name, type, schema_ref, required), operations (method, path, summary, request_schema_ref, security), parameters (method, path,
    ord, name, location, required, schema_ref), responses (method, path, status, description, schema_ref), security (name, type) and, optionally,
    interactions (transport and what operations have); those that are no HTTP refuse the contract, as do
    two operations of one method and path and component names that OpenAPI has no form for. A reference hides a field's type, a
    missing version is stated. Of rows that repeat a key otherwise, one stays. No contracts give no rows.

    Operations are written once, each by one pass over what is said of it; then all of a contract, with what refuses it, meets in
    one task by one shuffle, and its document is folded there in one pass, one document at a time.
    """
    work = Workspace(tables["contracts"].sparkSession, "openapi")
    contracts, operations = tables["contracts"], tables["operations"]
    refused = []
    if "interactions" in tables:
        others = tables["interactions"]
        refused.append((others.where("transport != 'http'"), F.concat(F.lit("unsupported transport "), "transport")))
        operations = operations.unionByName(others.where("transport = 'http'").select(*operations.columns))
    written = work.save(_operations(operations, tables["parameters"], tables["responses"]), "operations")
    step = lambda i: F.substring(F.get("path", F.lit(i)), F.lit(2), F.length(F.get("path", F.lit(i))))
    refused.append((written.where("repeated"), F.concat(F.lit("two operations on "), F.upper(step(2)), F.lit(" "), step(1))))
    refused.append((tables["schemas"].where(~F.col("name").rlike(_NAME)), F.concat(F.lit("invalid component name "), "name")))

    info = [key("info")]
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    servers = tables["environments"].select("contract", "ord", "name", F.posexplode("servers").alias("pos", "url"))
    server = [key("servers"), place(F.col("ord") * 100_000 + F.col("pos"))]
    components = [key("components"), key("schemas")]
    rows = [
        _rows(contracts, [key("openapi")], F.lit('"3.1.0"')),
        _rows(contracts, [*info, key("title")], quoted(F.col("title"))),
        _rows(contracts, [*info, key("version")], quoted(F.when(said("version"), F.col("version")).otherwise("0.0.0"))),
        _rows(contracts, [*info, key(STATUS_KEY)], F.lit(f'"{MISSING}"'), F.col("version").isNull()),
        *[_rows(contracts, [*path, HERE], F.lit(empty)) for path, empty in (([key("servers")], "[]"), ([key("paths")], "{}"), (components, "{}"), ([key("components"), key("securitySchemes")], "{}"))],
        _rows(servers, [*server, key("url")], quoted(F.col("url"))),
        _rows(servers, [*server, key("description")], quoted(F.col("name"))),
        written.drop("repeated"),
        *_schema_rows(tables["schemas"], tables["fields"], components),
        _rows(tables["security"], [key("components"), key("securitySchemes"), key(F.col("name")), key("type")], quoted(F.col("type"))),
    ]
    mark = lambda df, value: df.select("contract", F.lit(None).cast(_STEPS).alias("path"), value.alias("value"))
    rows += [mark(contracts, F.lit(None).cast("string")), *[mark(df, reason).where("value is not null") for df, reason in refused]]
    schema = T.StructType([contracts.schema["contract"], T.StructField("content", T.StringType()), T.StructField("error", T.StringType())])

    def documents(key: tuple, it: _Document) -> list[tuple]:
        nobody = key[0] is None
        return [(*key, None if nobody or it.error is not None else it.tree.json(), None if nobody else it.error)] * it.asked

    return _by_key(_union(rows), ["contract"], schema, _Document, documents)


#: Root types of a GraphQL schema, in order.
ROOTS = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}


def graphql_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """(contract, content, error): each contract's GraphQL interactions and schemas as SDL, or why they can't be written.

    ``tables``: contracts, schemas (ord, name), fields, interactions (transport, operation_kind, root_field, output_schema_ref, output_required). A root type
    lists its fields by name, then come the schemas in order with theirs. An interaction of another transport, without output schema
    or with one that is none of the contract's, two interactions on one root field and a schema field without type refuse
    the contract. A contract without both is empty text.
    """
    contracts, schemas, others = tables["contracts"], tables["schemas"], tables["interactions"]
    fields = tables["fields"].withColumn("kind", F.coalesce(F.when(F.col("schema_ref") != "", F.col("schema_ref")), "type"))
    mine = others.where("transport = 'graphql'")
    unresolved = mine.where("output_schema_ref is not null").join(schemas.select("contract", F.col("name").alias("output_schema_ref")), ["contract", "output_schema_ref"], "left_anti")
    refused = [
        (others.where("transport != 'graphql'"), F.concat(F.lit("unsupported transport "), "transport")),
        (mine.where("output_schema_ref is null"), F.lit("no output schema")),
        (unresolved, F.concat(F.lit("unresolved output schema "), "output_schema_ref")),
        (_repeats(mine, ["operation_kind", "root_field"]), F.concat(F.lit("two interactions on "), "operation_kind", F.lit(" "), "root_field")),
        (fields.where("kind is null"), F.concat(F.lit("no type of "), "schema", F.lit("."), "name")),
    ]
    needed = lambda flag: F.when(F.coalesce(F.col(flag), F.lit(False)), "!").otherwise("")
    line = lambda name, kind, flag: F.concat(F.lit("  "), F.col(name), F.lit(": "), F.col(kind), needed(flag))
    block = lambda name, lines: F.concat(F.lit("type "), name, F.lit(" {\n"), F.array_join(lines, "\n"), F.lit("\n}"))
    root_name = F.create_map(*[F.lit(x) for pair in ROOTS.items() for x in pair])[F.col("operation_kind")]
    order = F.array_position(F.array(*map(F.lit, ROOTS)), F.col("operation_kind"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("root_field", line("root_field", "output_schema_ref", "output_required").alias("line")))), lambda x: x["line"])
    roots = mine.groupBy("contract", "operation_kind").agg(lines.alias("lines")).select("contract", F.lit(0).alias("part"), order.cast("long").alias("ord"), block(root_name, F.col("lines")).alias("text"))
    texts = fields.groupBy("contract", F.col("schema").alias("name")).agg(F.sort_array(F.collect_list(line("name", "kind", "required"))).alias("lines"))
    types = schemas.join(texts, ["contract", "name"], "left").select("contract", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), block(F.col("name"), F.coalesce("lines", F.array().cast("array<string>"))).alias("text"))
    blocks = roots.unionAll(types).groupBy("contract").agg(F.sort_array(F.collect_list(F.struct("part", "ord", "text"))).alias("blocks"))
    content = blocks.select("contract", F.concat(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"), F.lit("\n")).alias("content"))
    whole = contracts.select("contract").join(content, "contract", "left").select("contract", F.coalesce("content", F.lit("")).alias("content"))
    return _with_errors(contracts, whole, _refusals(refused))


def endpoint_sections(tables: dict[str, DataFrame]) -> DataFrame:
    """(contract, method, path, text): a Markdown section for each operation: heading, summary, parameters and answers as tables in order."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    op = ["contract", "method", "path"]
    row = lambda columns: F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    ordered = lambda df, by, columns, name: df.groupBy(*op).agg(F.transform(F.sort_array(F.collect_list(F.struct(by, row(columns).alias("line")))), lambda x: x["line"]).alias(name))
    parameters = ordered(tables["parameters"], "ord", ["name", "location", "required", "schema_ref"], "parameters")
    answers = ordered(tables["responses"], "status", ["status", "description", "schema_ref"], "answers")
    met = tables["operations"].select(*op, "summary").join(parameters, op, "left").join(answers, op, "left")
    table = lambda head, lines: F.when(F.col(lines).isNotNull(), F.concat(F.lit(f"\n\n| {' | '.join(head)} |\n|{'---|' * len(head)}\n"), F.array_join(lines, "\n"))).otherwise("")
    text = F.concat(F.lit("## "), F.upper("method"), F.lit(" "), "path", F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("\n\n"), "summary")).otherwise(""), table(["name", "in", "required", "schema"], "parameters"), table(["status", "description", "schema"], "answers"), F.lit("\n"))
    return met.select(*op, text.alias("text"))


def markdown_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """(contract, content): the title and the sections of all operations, by path and method."""
    sections = endpoint_sections(tables).groupBy("contract").agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "method", "text"))), lambda s: s["text"]).alias("sections"))
    met = tables["contracts"].select("contract", "title").join(sections, "contract", "left")
    return met.select("contract", F.concat(F.lit("# "), "title", F.lit("\n"), F.when(F.col("sections").isNull(), "").otherwise(F.concat(F.lit("\n"), F.array_join("sections", "\n")))).alias("content"))
