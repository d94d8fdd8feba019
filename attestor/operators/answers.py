"""Structured answers of an extraction coerced to typed items, with the reason of each that is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.json_text import json_block
from attestor.operators.planning import STAGES
from attestor.session import Workspace

#: By stage, the fields of an item and what they have to be. A list that is empty, false or zero counts as empty.
FIELDS = {
    "03": {"name": "text", "base_url": "text", "version": "text"},
    "04": {"name": "text", "type": "text", "location": "text", "details": "text"},
    "05": {"method": "text", "path": "text", "summary": "text", "server": "text"},
    "07": {"name": "text", "fields": "objects", "enums": "list", "constraints": "text"},
    "08": {"code": "text", "meaning": "text", "http_status": "text", "applicable_to": "texts"},
    "09": {"topic": "text", "detail": "text", "applies_to": "operations"},
}
#: What names an item in a report, the first that is there.
LABELS = ["path", "name", "code"]
_LIST = "array<variant>"


def _member(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(item: Column, name: str) -> Column:
    """A member that is a string, else null."""
    return F.when(_kind(_member(item, name)) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def _is_none(value: Column) -> Column:
    return value.isNull() | F.coalesce(_kind(value) == "VOID", F.lit(False))


def _is_text(value: Column) -> Column:
    return _is_none(value) | F.coalesce(_kind(value) == "STRING", F.lit(False))


def _fits(value: Column, kind: str) -> Column:
    if kind == "text":
        return _is_text(value)
    object_ = lambda x: F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False))
    each = {
        "list": lambda x: F.lit(True), "objects": object_, "texts": lambda x: F.coalesce(_kind(x) == "STRING", F.lit(False)),
        "operations": lambda x: object_(x) & F.coalesce(_kind(_member(x, "operation")) == "STRING", F.lit(False)) & _is_text(_member(x, "field")),
    }[kind]
    plain = F.try_variant_get(value, "$", "string").isin("", "false", "0", "0.0") & ~_kind(value).startswith("ARRAY") & ~_kind(value).startswith("OBJECT")
    empty = _is_none(value) | F.coalesce(plain, F.lit(False)) | F.coalesce(_kind(value) == "OBJECT<>", F.lit(False))
    return empty | (F.coalesce(_kind(value).startswith("ARRAY"), F.lit(False)) & F.coalesce(F.forall(F.try_variant_get(value, "$", _LIST), each), F.lit(False)))


def _by_stage(each) -> Column:
    """``each`` of a stage for the stage that the row is of."""
    out = None
    for stage in FIELDS:
        out = F.when(F.col("stage") == stage, each(stage)) if out is None else out.when(F.col("stage") == stage, each(stage))
    return out


def _told(items: Column) -> Column:
    return F.transform(items, lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)))


def coerced_items(answers: DataFrame, manifest: DataFrame) -> DataFrame:
    """(run, stage, query_id, ord, kind, status, source, detail, payload): everything that the answers of an extraction hold, as one table.

    ``answers``: (run, stage, ord, query_id, answer), the answer a text around a JSON object; ``manifest``: (run, document, name).
    The last answer of a stage counts. ``kind`` is ``item`` (``supported`` where its source names a document of the run, or the run
    has only one, else ``unverified``, ``detail`` what it is called), ``missing`` or ``conflict``. What does not fit is a
    missing item: a stage whose answer is not there or holds no object (``no structured answer``), a collection that is no list (``malformed shape``), an item that
    is no object or whose field has another type (``malformed item``, ``payload`` the field's name). Gaps and conflicts that
    an answer tells of follow in order; what is no string there stays JSON.

    Types are read from the VARIANT values, so no schema is inferred and nothing is shuffled but by run. Answers are dealt out by run
    before the last of a stage is chosen, and their objects, cut out of the text once, are written: what is told of them is
    read from there, apart from the memory that choosing takes.
    """
    known = list(FIELDS)
    work = Workspace(answers.sparkSession, "answers")
    dealt = answers.where(F.col("stage").isin([*known, "10"])).select("run", "stage", "ord", "query_id", "answer").repartition("run")
    text = dealt.groupBy("run", "stage").agg(F.max_by(F.struct("query_id", "answer"), F.struct("ord", "query_id")).alias("a"))
    written = work.save(text.select("run", "stage", "a.query_id", json_block("a.answer").alias("block")), "blocks")
    last = written.withColumn("block", F.try_parse_json("block"))
    staged = last.where(F.col("stage").isin(known)).withColumn("raw", _by_stage(lambda s: _member(F.col("block"), STAGES[s])))
    area = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])[F.col("stage")]
    none = F.lit(None).cast("string")
    shape = ["run", "stage", "query_id", "ord", "kind", "status", "source", "detail", "payload"]

    stages = answers.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, known))).alias("stage"))
    silent = stages.join(last, ["run", "stage"], "left").where("block is null")
    silent = silent.select("run", "stage", "query_id", F.lit(-1).alias("ord"), F.lit("missing").alias("kind"), none.alias("status"), none.alias("source"), F.lit("no structured answer").alias("detail"), none.alias("payload"))
    is_list = _kind(F.col("raw")).startswith("ARRAY")
    bent = staged.where(~_is_none(F.col("raw")) & ~is_list).select("run", "stage", "query_id", F.lit(-1), F.lit("missing"), none, none, F.concat(F.lit("malformed shape for "), area), none)

    each = staged.where(is_list).select("run", "stage", "query_id", F.posexplode(F.try_variant_get("raw", "$", _LIST)).alias("ord", "item"))
    item = F.col("item")
    wrong = _by_stage(lambda s: F.coalesce(*[F.when(~_fits(_member(item, name), kind), F.lit(name)) for name, kind in FIELDS[s].items()]))
    judged = each.withColumn("wrong", F.when(_kind(item).startswith("OBJECT"), wrong).otherwise(F.lit("")))
    bad = judged.where("wrong is not null").select("run", "stage", "query_id", "ord", F.lit("missing"), none, none, F.concat(F.lit("malformed item in "), area), F.nullif("wrong", F.lit("")))
    label = F.coalesce(*[F.nullif(_text(item, name), F.lit("")) for name in LABELS], area)
    good = judged.where("wrong is null").select("run", "stage", "query_id", "ord", F.lower(_text(item, "source")).alias("name"), label.alias("detail"), F.to_json(item).alias("payload"))
    named = manifest.select("run", F.lower("name").alias("name"), "document").groupBy("run", "name").agg(F.min("document").alias("document"))
    sole = manifest.groupBy("run").agg(F.min("document").alias("only"), F.count_distinct("document").alias("n")).where("n = 1").select("run", "only")
    met = good.join(named, ["run", "name"], "left").join(sole, "run", "left").withColumn("source", F.coalesce("document", "only"))
    found = met.select("run", "stage", "query_id", "ord", F.lit("item"), F.when(F.col("source").isNull(), "unverified").otherwise("supported"), "source", "detail", "payload")

    said = lambda name, kind: last.select("run", "stage", "query_id", F.posexplode(_told(F.try_variant_get("block", f"$.{name}", _LIST))).alias("ord", "detail")).select("run", "stage", "query_id", "ord", F.lit(kind), none, none, "detail", none)
    out = silent
    for part in (bent, bad, found, said("missing", "missing"), said("conflicts", "conflict")):
        out = out.unionAll(part.toDF(*shape))
    return out
