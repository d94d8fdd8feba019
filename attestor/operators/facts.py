"""Mechanical facts of Markdown sources: lines, sections, endpoints, tables and fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attestor.functions import text
from attestor.operators import tables
from attestor.operators.manifest import row_numbers
from attestor.session import Workspace

#: An ATX heading of one to six marks; closing marks are no part of it.
HEADING = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
#: What makes a heading of the line of text above it.
UNDERLINE = r"^ {0,3}(?:=+|-{2,})[ \t]*$"
#: A run of three or more of one fence character, and what stands behind it.
FENCE = r"^ {0,3}(([`~])\2{2,})(.*)$"
#: What a fence may say it holds to count as an example, and how its content may begin where it says nothing of these.
PAYLOADS = ["json", "xml", "http", "curl", "yaml", "yml", "javascript", "js", "response", "request", "jsonc", "html"]
PAYLOAD_STARTS = ["{", "[", "<"]


def fence_spans(body: Column) -> Column:
    """Array of (opened, closed) lines of the fences of a text, ``closed`` null where one stays open.

    A fence closes at a run of its own character, at least as long, with nothing behind it; any other run inside it is
    content. One fold over the lines that hold runs, in order.
    """
    marks = F.filter(F.transform(_split(body), lambda x, i: F.named_struct(F.lit("line"), i + 1, F.lit("text"), x)), lambda x: x.text.rlike(FENCE))
    runs = F.transform(marks, lambda x: F.named_struct(F.lit("line"), x.line, F.lit("run"), F.regexp_extract(x.text, FENCE, 1), F.lit("info"), F.trim(F.regexp_extract(x.text, FENCE, 3))))
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("line"), F.lit("").alias("run"), F.array().cast("array<struct<opened:int,closed:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        opens = acc.line.isNull()
        closes = ~opens & (x["info"] == "") & x.run.startswith(acc.run)
        span = F.named_struct(F.lit("opened"), acc.line, F.lit("closed"), x.line)
        return F.named_struct(
            F.lit("line"), F.when(opens, x.line).when(closes, none).otherwise(acc.line), F.lit("run"), F.when(opens, x.run).otherwise(acc.run),
            F.lit("spans"), F.when(closes, F.concat(acc.spans, F.array(span))).otherwise(acc.spans),
        )

    left = lambda acc: F.when(acc.line.isNull(), acc.spans).otherwise(F.concat(acc.spans, F.array(F.named_struct(F.lit("opened"), acc.line, F.lit("closed"), none))))
    any_marks = body.contains("```") | body.contains("~~~")
    return F.when(any_marks, F.aggregate(runs, start, step, left)).otherwise(F.array().cast("array<struct<opened:int,closed:int>>"))


def _split(body: Column) -> Column:
    return F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n", -1)


def lines(docs: DataFrame, source: str, body: str) -> DataFrame:
    """(source, line, text): the lines of every document from 1."""
    return docs.select(F.col(source).alias("source"), F.posexplode(_split(F.col(body))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def marked_lines(docs: DataFrame, source: str, body: str) -> DataFrame:
    """Lines with ``in_fence``, ``opens_fence``, ``level`` (0 if no heading), ``heading`` and the endpoint a line declares outside fences.

    A line of text that the next one underlines is a heading, of level 1 by equal signs and 2 by dashes, from its underline on.
    The lines of a fence's own marks are no content: neither inside nor outside. Each document's fences are found in one
    fold over its runs, and a line looks up whether it is between two. Lines leave with the one before them, so none is
    shuffled; ``is_last`` marks the last.
    """
    split = docs.select(F.col(source).alias("source"), fence_spans(F.col(body)).alias("spans"), _split(F.col(body)).alias("all"))
    pairs = F.arrays_zip(F.col("all").alias("text"), F.slice(F.concat(F.array(F.lit(None).cast("string")), "all"), F.lit(1), F.size("all")).alias("before"))
    rows = split.select("source", "spans", F.size("all").alias("n"), F.posexplode(pairs).alias("line", "x")).select("source", "spans", "n", (F.col("line") + 1).alias("line"), "x.text", "x.before")
    at = F.col("line")
    opens = lambda at: F.exists("spans", lambda s: s.opened == at)
    marker = lambda at: opens(at) | F.exists("spans", lambda s: s.closed.eqNullSafe(at))
    inside = lambda at: F.exists("spans", lambda s: (s.opened < at) & (s.closed.isNull() | (at < s.closed)))
    title = F.when(F.col("text").rlike(UNDERLINE) & (F.trim("before") != "") & ~F.col("before").rlike(HEADING) & ~F.col("before").rlike(r"^\s*\|") & ~inside(at - 1) & ~marker(at - 1), F.trim("before"))
    rows = rows.withColumns({"opens_fence": opens(at), "is_marker": marker(at), "in_fence": inside(at), "title": title, "is_last": at == F.col("n")}).drop("spans", "n", "before")
    rows = rows.withColumn("free", ~F.col("in_fence") & ~F.col("is_marker")).withColumn("title", F.when(F.col("free"), F.col("title")))
    level = F.when(F.col("title").isNotNull(), F.when(F.ltrim("text").startswith("="), 1).otherwise(2)).when(F.col("free"), F.length(F.regexp_extract("text", HEADING, 1))).otherwise(0)
    rows = rows.withColumns({"level": level, "heading": F.coalesce("title", F.when(level > 0, F.regexp_extract("text", HEADING, 2))), "endpoint": F.when(F.col("free"), text.declared_endpoint(F.col("text")))})
    return rows.drop("free", "title")


def landmarks(marked: DataFrame) -> DataFrame:
    """The lines of ``marked`` that say where sections, tables and fences are, and the last line of each document.

    section_owner() and tables() give these lines what they give them among all lines; an owner changes at none of the others.
    """
    row = F.col("text").rlike(r"^\s*\|") & ~F.col("in_fence")
    return marked.where((F.col("level") > 0) | F.col("endpoint").isNotNull() | F.col("opens_fence") | row | F.col("is_last"))


def section_owner(marked: DataFrame) -> DataFrame:
    """Lines with the endpoint whose section they are in.

    A declaration starts a section at the level of the heading above it; the section ends at the next heading of that level
    or above, or at any heading for a declaration above all headings. The last break before a line decides, by windows.
    """
    w = W.partitionBy("source").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    above = F.last(F.when(F.col("level") > 0, F.col("level")), ignorenulls=True).over(w)
    rows = marked.withColumn("above", F.coalesce(above, F.lit(99)))
    start = F.when(F.col("endpoint").isNotNull(), F.struct("line", F.col("above").alias("level"), "endpoint"))
    rows = rows.withColumn("start", F.last(start, ignorenulls=True).over(w))
    ends = F.max(F.when(F.col("level") > 0, F.struct("line", "level"))).over(w)
    rows = rows.withColumn("last_heading", ends)
    breaks = F.max(F.when((F.col("level") > 0) & (F.col("level") <= F.col("start.level")) & (F.col("line") > F.col("start.line")), F.col("line"))).over(W.partitionBy("source", F.col("start.line")).orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    owner = F.when(breaks.isNull(), F.col("start.endpoint"))
    return rows.withColumn("owner", owner).drop("start", "last_heading", "above")


def endpoint_facts(docs: DataFrame, source: str, body: str) -> DataFrame:
    """(source, method, path, line, last_line, n_fences, parameters) of every declared endpoint.

    Parameters are what the tables of its section list (table_parameters()). Of all lines only landmarks() leave their document;
    a section reaches to the line before the next of these. They are written once, as both sides read them.
    """
    rows = section_owner(landmarks(marked_lines(docs, source, body)))
    until = F.coalesce(F.lead("line").over(W.partitionBy("source").orderBy("line")) - 1, F.col("line"))
    owned = rows.withColumn("until", until).select("source", "line", "until", "text", "level", "heading", "in_fence", "opens_fence", "owner")
    rows = Workspace(docs.sparkSession, "facts").save(owned, "owned")
    key = ["source", "method", "path"]
    listed = tables.table_parameters(tables.tables(rows)).groupBy(*key).agg(F.array_sort(F.collect_set("name")).alias("parameters"))
    spans = rows.where("owner is not null").groupBy("source", "owner.method", "owner.path").agg(F.min("line").alias("line"), F.max("until").alias("last_line"), F.count_if("opens_fence").alias("n_fences"))
    return spans.join(listed, key, "left").select(*key, "line", "last_line", "n_fences", F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters"))


def payload_fences(docs: DataFrame, source: str, body: str) -> DataFrame:
    """(source, method, path, info, start_line, end_line, excerpt) of the fences in an endpoint's section that hold an example.

    A fence holds one if its info names a payload, or else if its first line with anything on it begins like one. It ends at its closing
    mark, or with the text. Lines find their fence by the last opening mark before them, so a fence's content is gathered by
    document and opening line.
    """
    own = docs.select(source, F.regexp_replace(body, r"(\r\n|\r|\n)\z", "").alias(body))
    marked = marked_lines(own, source, body)
    rows = section_owner(marked.where((F.col("level") > 0) | F.col("endpoint").isNotNull() | F.col("in_fence") | F.col("is_marker")))
    at = F.last(F.when(F.col("opens_fence"), F.col("line")), ignorenulls=True).over(W.partitionBy("source").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    inside = rows.withColumn("start_line", at).where("in_fence or is_marker")
    content = F.when(F.col("in_fence"), F.struct("line", "text"))
    first = F.min(F.when(F.col("in_fence") & F.col("text").rlike(r"(?U)\S"), F.struct("line", F.regexp_extract("text", r"(?U)\S", 0).alias("start"))))
    fences = inside.groupBy("source", "start_line").agg(
        F.max(F.when(F.col("opens_fence"), F.struct("owner.method", "owner.path"))).alias("owner"), F.max(F.when(F.col("opens_fence"), F.lower(F.regexp_replace(F.regexp_extract("text", FENCE, 3), r"(?U)^\s+|\s+$", "")))).alias("info"),
        F.max("line").alias("end_line"), first.alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(content)), lambda x: x["text"]), "\n").alias("told"),
    )
    held = fences.where(F.col("owner.path").isNotNull() & (F.col("info").isin(PAYLOADS) | F.coalesce(F.col("first.start").isin(PAYLOAD_STARTS), F.lit(False))))
    return held.select("source", "owner.method", "owner.path", "info", "start_line", "end_line", text.normalize_excerpt(F.col("told")).alias("excerpt"))


def draft_endpoints(docs: DataFrame, source: str, body: str) -> DataFrame:
    """The lenient twin for drafts (V04): any line that names a method and a path counts, whatever stands before."""
    pattern = r"(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+`?(/[A-Za-z0-9_{}./:-]*)"
    rows = lines(docs, source, body).where(F.col("text").rlike(pattern))
    return rows.select("source", "line", F.upper(F.regexp_extract("text", pattern, 1)).alias("method"), F.regexp_extract("text", pattern, 2).alias("path"))


def unclosed_fences(docs: DataFrame, source: str, body: str) -> DataFrame:
    """(source, opened): documents whose last fence stays open, with the line it opened in."""
    return docs.select(F.col(source).alias("source"), F.try_element_at(F.filter(fence_spans(F.col(body)), lambda s: s.closed.isNull()), F.lit(1)).alias("span")).where("span is not null").select("source", F.col("span.opened").alias("opened"))


def merge_facts(facts: DataFrame) -> DataFrame:
    """Facts of one endpoint in several sections: parameters that every section has, the fewest fences."""
    flat = facts.withColumn("unit", F.concat_ws("#", "source", "line"))
    units = flat.groupBy("method", "path").agg(F.count_distinct("unit").alias("units"), F.min("n_fences").alias("n_fences"))
    have = flat.select("method", "path", "unit", F.explode("parameters").alias("p")).distinct().groupBy("method", "path", "p").agg(F.count("*").alias("n"))
    kept = have.join(units, ["method", "path"]).where("n = units").groupBy("method", "path").agg(F.array_sort(F.collect_set("p")).alias("parameters"))
    return units.join(kept, ["method", "path"], "left").withColumn("parameters", F.coalesce("parameters", F.array().cast("array<string>")))


def error_code_floor(facts: DataFrame) -> DataFrame:
    """Every documented error code with its facts counted across sources."""
    return facts.groupBy("code").agg(F.count("*").alias("n_facts"), F.count_distinct("source").alias("n_sources"), F.min("ord").alias("first_ord"))


def first_drafts(drafts: DataFrame) -> DataFrame:
    """The first draft of each method and path."""
    return drafts.groupBy("method", "path").agg(F.min(F.struct("source", "line")).alias("at")).select("at.source", "at.line", "method", "path")


def scaffold(drafts: DataFrame, start: int = 0) -> DataFrame:
    """Every draft endpoint as an extraction file, numbered in order of source, line, method and path."""
    numbered = row_numbers(drafts.select("source", "line", "method", "path"), ["source", "line", "method", "path"], "n")
    return numbered.select(F.format_string("ep%02d.json", F.col("n") - 1 + start).alias("file"), "method", "path", "source", "line")
