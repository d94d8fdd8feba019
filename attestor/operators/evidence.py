"""Evidence fragments by locator: pages, line ranges, heading paths and JSON pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attestor.functions.text import normalize_excerpt
from attestor.operators.derivations import json_nodes
from attestor.operators.facts import marked_lines

PAGE = r"(?iU)^.+?\s+(?:p\.|page\s+)(\d+)$"
LINES = r"(?iU)^.+?\s+lines?\s+(\d+)-(\d+)$"
POINTER = r"(?i)^.+?\.(?:json|ya?ml)#((?:/.*)?)$"
PAGE_MARKER = r"(?iU)^\s*<!--\s*page\s*:\s*(\d+)\s*-->\s*$"
#: Every end of line that a reader of text knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

#: Lines of a document that travel as one row.
BLOCK_LINES = 64


def source_locator(raw: Column) -> Column:
    """What a locator written as ``<source> page 3``, ``<source> lines 2-5``, ``<source>.json#/a/b``, ``css:``, ``xpath:`` or ``section:A > B`` asks for."""
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    number = lambda form, group: F.regexp_extract(text, form, group).try_cast("int")
    headings = F.filter(F.transform(F.split(F.substring(text, 9, 1 << 30), ">"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    kind = (
        F.when(text.rlike(PAGE), "page").when(text.rlike(LINES), "lines").when(text.rlike(POINTER), "pointer").when(text.startswith("css:"), "css").when(text.startswith("xpath:"), "xpath")
        .when(text.startswith("section:") & (F.size(headings) > 0), "section").otherwise("unresolved")
    )
    return F.struct(
        kind.alias("kind"), F.when(kind == "page", number(PAGE, 1)).alias("page"), F.when(kind == "lines", number(LINES, 1)).alias("first"), F.when(kind == "lines", number(LINES, 2)).alias("last"),
        F.when(kind == "pointer", F.regexp_extract(text, POINTER, 1)).alias("pointer"), F.when(kind == "section", headings).alias("headings"),
    )


def _text_lines(body: Column) -> Column:
    parts = F.split(body, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def heading_spans(docs: DataFrame, source: str, body: str, only: DataFrame | None = None) -> DataFrame:
    """(source, headings, first, last): each section as an interval of lines, its own heading and those around it, outermost first.

    A section reaches to the line before the next heading of its level or above. Only the lines that are headings take
    part in the windows, and of these only those of the sources in ``only`` (source) if it is given.
    """
    heads = marked_lines(docs, source, body).where("level > 0").select("source", "line", "level", "heading")
    heads = heads if only is None else heads.join(only, "source", "left_semi")
    back = W.partitionBy("source").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("source").orderBy("line").rowsBetween(1, W.unboundedFollowing)
    level = F.col("level")
    seen = heads.select("*", *[F.max(F.when(level == k, F.struct("line", "heading"))).over(back).alias(f"at{k}") for k in range(1, 7)], *[F.min(F.when(level <= k, F.col("line"))).over(ahead).alias(f"end{k}") for k in range(1, 7)])
    stack = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"at{j}.line"), F.lit(0)) for j in range(1, k)]
        open_ = (level >= k) & (F.col(f"at{k}.line") > F.greatest(F.lit(0), F.lit(0), *above))
        stack.append(F.when(open_, F.col(f"at{k}.heading")))
    end = F.element_at(F.array(*[F.col(f"end{k}") for k in range(1, 7)]), level)
    return seen.select("source", F.filter(F.array(*stack), lambda h: h.isNotNull()).alias("headings"), F.col("line").alias("first"), (end - 1).alias("last"))


def acquire_fragments(documents: DataFrame, requests: DataFrame, sections: bool = False) -> DataFrame:
    """(source, raw, kind, precision, excerpt, digest): the fragment that each locator (source, raw) asks of its document (source, text).

    Lines count from 1; a page is everything behind its marker ``<!-- page: 3 -->`` to the next marker, all its places
    together; a pointer gives canonical JSON. What is found is ``exact``; all else is ``unresolved`` and carries the digest of
    the whole document. With ``sections`` a heading path gives the one section whose headings end with it, of precision
    ``section``; without it, or where several sections fit, it is unresolved, as are selectors.

    A request becomes the blocks of lines of its intervals, which meet the blocks of the documents by source and number: no document is
    repeated for its requests, and a source that many ask for is split like any join. What documents have beside their lines (numbers,
    markers, headings) is found where they are read. A source has one document; sources
    without one and null texts leave requests unresolved, without a digest. Repeated requests count once; list places in pointers are plain numbers.
    """
    asked = requests.select("source", "raw").distinct().withColumn("at", source_locator(F.col("raw")))
    docs = documents.select("source", "text").where("text is not null")
    split = docs.select("source", _text_lines(F.col("text")).alias("all"))
    cut = lambda i: F.slice("all", i * BLOCK_LINES + 1, F.lit(BLOCK_LINES))
    blocks = split.select("source", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(all) - 1) div {BLOCK_LINES} as int)")), cut)).alias("block", "lines"))
    lines = split.select("source", F.posexplode("all").alias("line", "text")).withColumn("line", F.col("line") + 1)
    ends = docs.select("source", F.size(_text_lines(F.col("text"))).alias("n"), F.sha2("text", 256).alias("whole"))

    ranges = asked.where("at.kind = 'lines'").join(ends, "source").where("at.first between 1 and at.last and at.last <= n").select("source", "raw", "at.first", "at.last")
    w = W.partitionBy("source").orderBy("line")
    marks = lines.where(F.col("text").rlike(PAGE_MARKER)).select("source", F.regexp_extract("text", PAGE_MARKER, 1).try_cast("int").alias("page"), (F.col("line") + 1).alias("first"), (F.lead("line").over(w) - 1).alias("next"))
    pages = asked.where("at.kind = 'page'").select("source", "raw", "at.page").join(marks, ["source", "page"]).join(ends, "source").select("source", "raw", "first", F.coalesce("next", "n").alias("last"))
    spans = ranges.unionAll(pages)
    if sections:
        wanted = asked.where("at.kind = 'section'").select("source", "raw", F.col("at.headings").alias("path"), F.element_at("at.headings", -1).alias("heading"))
        held = heading_spans(documents, "source", "text", wanted.select("source").distinct()).withColumn("heading", F.element_at("headings", -1))
        fits = (F.size("headings") >= F.size("path")) & (F.slice("headings", F.greatest(F.size("headings") - F.size("path") + 1, F.lit(1)), F.size("path")) == F.col("path"))
        met = wanted.join(held, ["source", "heading"]).where(fits).groupBy("source", "raw").agg(F.count("*").alias("fitting"), F.min("first").alias("first"), F.min("last").alias("last"))
        spans = spans.unionAll(met.where("fitting = 1").join(ends, "source").select("source", "raw", "first", F.coalesce("last", "n").alias("last")))
    number = lambda line: F.expr(f"cast(({line} - 1) div {BLOCK_LINES} as int)")
    each = spans.where("first <= last").select("source", "raw", "first", "last", F.explode(F.sequence(number("first"), number("last"))).alias("block"))
    start = F.greatest(F.col("first") - F.col("block") * BLOCK_LINES, F.lit(1))
    part = F.slice("lines", start, F.least(F.col("last") - F.col("block") * BLOCK_LINES, F.lit(BLOCK_LINES)) - start + 1)
    parts = each.join(blocks, ["source", "block"]).select("source", "raw", F.struct((F.col("block") * BLOCK_LINES + start).alias("line"), F.array_join(part, "\n").alias("text")).alias("part"))
    told = parts.groupBy("source", "raw").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["text"]), "\n").alias("told"))
    found = spans.select("source", "raw").distinct().join(told, ["source", "raw"], "left").select("source", "raw", normalize_excerpt(F.coalesce("told", F.lit(""))).alias("excerpt"))

    pointed = asked.where("at.kind = 'pointer'").select("source", "raw", "at.pointer")
    nodes = json_nodes(docs.join(pointed.select("source").distinct(), "source", "left_semi"), "text", ["source"], where="")
    found = found.unionAll(pointed.join(nodes, ["source", "pointer"]).select("source", "raw", "value"))
    precision = F.when(F.col("excerpt").isNull(), "unresolved").when(F.col("at.kind") == "section", "section").otherwise("exact")
    out = asked.join(found, ["source", "raw"], "left").join(ends, "source", "left")
    return out.select("source", "raw", "at.kind", precision.alias("precision"), "excerpt", F.coalesce(F.sha2("excerpt", 256), "whole").alias("digest"))


def refuted_references(references: DataFrame, documents: DataFrame, sections: bool = False) -> DataFrame:
    """(source, raw, digest, found, reason) of declared references (source, raw, digest) that the documents don't bear out."""
    met = references.join(acquire_fragments(documents, references, sections).withColumnRenamed("digest", "found"), ["source", "raw"])
    reason = F.when(F.col("precision") == "unresolved", "unresolved").when(~F.col("digest").eqNullSafe(F.col("found")), "digest_mismatch")
    return met.select("source", "raw", "digest", "found", reason.alias("reason")).where("reason is not null")
