"""Tables of Markdown sources: parameters of the endpoint whose section they stand in, and documented error codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attestor.functions import text

#: The rule under a table's header: dashes, with colons and pipes.
SEPARATOR = r"^[ \t]*(?=[^-]*-)[|:\- \t]+$"
_EDGE = "[`*_ ]+"
#: Words in the header of a column of names.
NAME_HEADERS = ["name", "field", "parameter", "param", "attribute", "property", "key", "參數", "欄位", "名稱", "屬性", "變數", "參數名", "键", "键名"]
#: A second header that makes a table one of constants, and headers that are no parameters.
CONSTANT_HEADERS = ["value", "值", "內容", "example value"]
NEGOTIATION = ["content-type", "accept", "content-length", "accept-encoding"]
#: Headers of a column of error codes, those that need an error section around them, and what names such a section.
ERROR_HEADERS = ["錯誤碼", "錯誤代碼", "回應碼", "error code", "errcode"]
AMBIGUOUS_HEADERS = ["代碼", "狀態碼", "status code", "code"]
ERROR_SECTIONS = ["錯誤", "例外", "error", "exception"]
#: Words in the header of a column that says what is required.
REQUIRED_HEADERS = ["required", "mandatory", "必填", "是否必填"]
#: The shapes of an identifier and of an error code.
IDENTIFIER, ERROR_CODE = r"^[A-Za-z_][A-Za-z0-9_.\-]*$", r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,31}$"


def _holds(value: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: value.contains(w))


def _bare(cell: Column) -> Column:
    return F.regexp_replace(F.trim(cell), f"^{_EDGE}|{_EDGE}$", "")


def _blank(cells: Column, but: Column) -> Column:
    """Whether a row of several cells has nothing beside one of them."""
    return (F.size(cells) > 1) & ~F.exists(F.filter(cells, lambda c, i: i != but), lambda c: c != "")


def enclosing_headings(marked: DataFrame) -> DataFrame:
    """``marked`` (source, line, level, heading) with ``headings``: those of the sections around each line, outermost first."""
    w = W.partitionBy("source").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == n, F.struct("line", "heading")), ignorenulls=True).over(w).alias(f"h{n}") for n in range(1, 7)]
    rows = marked.select("*", *last)
    open_ = [F.when(F.col(f"h{n}.line") > F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(f"h{m}.line"), F.lit(0)) for m in range(1, n)]), F.col(f"h{n}.heading")) for n in range(1, 7)]
    return rows.withColumn("headings", F.filter(F.array(*open_), lambda h: h.isNotNull())).drop(*[f"h{n}" for n in range(1, 7)])


def tables(owned: DataFrame) -> DataFrame:
    """(source, line, last_line, owner, headings, header, body) of every table outside fences, from lines with their owner.

    Of the lines all headings and rows of tables are needed (facts.landmarks()), others may be left out.
    Lines that begin with a pipe and follow each other are one block, which meets in one row; it is a table if a header, a rule and one
    row at least are there. ``body`` has line, text and cells of the rows below the rule, in order.
    """
    rows = enclosing_headings(owned).withColumn("is_row", F.col("text").rlike(r"^\s*\|") & ~F.col("in_fence"))
    block = F.col("line") - F.sum(F.col("is_row").cast("int")).over(W.partitionBy("source").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    one = F.struct("line", "text", text.table_cells(F.col("text")).alias("cells"))
    found = rows.withColumn("block", block).where("is_row").groupBy("source", "block").agg(F.sort_array(F.collect_list(one)).alias("rows"), F.min_by(F.struct("owner", "headings"), "line").alias("at"))
    found = found.where((F.size("rows") >= 3) & F.get("rows", F.lit(1))["text"].rlike(SEPARATOR))
    return found.select("source", F.get("rows", F.lit(0))["line"].alias("line"), F.element_at("rows", -1)["line"].alias("last_line"), "at.owner", "at.headings", F.get("rows", F.lit(0))["cells"].alias("header"), F.slice("rows", F.lit(3), F.size("rows")).alias("body"))


def table_parameters(found: DataFrame) -> DataFrame:
    """(source, table, method, path, line, name, required) of the parameters that the tables of each endpoint's section list, in whole tables.

    A table counts whose first header names a column of names and whose second doesn't make it one of constants. What follows a row
    that only announces error codes is another table. Names stand in the first column, or in a later one that is headed as such and
    holds identifiers alone where the first does not. Rows with a name and nothing beside it are headings; content negotiation is no
    parameter. ``required`` is true, false or what the column for it says; null without one.
    """
    is_name = lambda c: _holds(F.lower(text.field_name(c)), NAME_HEADERS)
    second = F.coalesce(F.lower(F.get("header", F.lit(1))), F.lit(""))
    mine = found.where(F.col("owner").isNotNull() & is_name(F.get("header", F.lit(0))) & ~second.isin(CONSTANT_HEADERS))

    def announces(row: Column) -> Column:
        said = F.filter(row["cells"], lambda c: c != "")
        return (F.size(said) == 1) & F.lower(F.regexp_replace(_bare(F.get(said, F.lit(0))), "[:：]+$", "")).isin(ERROR_HEADERS)

    stop = F.get(F.filter(F.transform("body", lambda r, i: F.when(announces(r), i)), lambda i: i.isNotNull()), F.lit(0))
    mine = mine.withColumn("stop", stop).withColumn("body", F.when(F.col("stop").isNull(), F.col("body")).otherwise(F.slice("body", F.lit(1), F.col("stop"))))

    def identifiers(i: Column) -> Column:
        names = F.filter(F.transform("body", lambda r: text.field_name(F.get(r["cells"], i))), lambda n: n.isNotNull() & (n != ""))
        return (F.size(names) > 0) & F.forall(names, lambda n: n.rlike(IDENTIFIER))

    later = F.filter(F.transform("header", lambda h, i: F.when((i > 0) & is_name(h) & identifiers(i), i)), lambda i: i.isNotNull())
    needed = F.filter(F.transform("header", lambda h, i: F.when(_holds(F.lower(text.field_name(h)), REQUIRED_HEADERS), i)), lambda i: i.isNotNull())
    mine = mine.withColumns({"at": F.when(identifiers(F.lit(0)) | (F.size("body") == 0), F.lit(0)).otherwise(F.coalesce(F.get(later, F.lit(0)), F.lit(0))), "needed": F.get(needed, F.lit(0))})
    rows = mine.select("source", F.col("line").alias("table"), "owner", "at", "needed", F.explode("body").alias("row"))
    rows = rows.where(~_blank(F.col("row.cells"), F.lit(0)) & (F.col("at") < F.size("row.cells"))).withColumn("name", text.field_name(F.get("row.cells", F.col("at"))))
    said = F.when(F.col("needed").isNotNull() & (F.col("needed") != F.col("at")), text.required_flag(_bare(F.get("row.cells", F.col("needed")))))
    return rows.where((F.col("name") != "") & ~F.lower("name").isin(NEGOTIATION)).select("source", "table", "owner.method", "owner.path", "row.line", "name", said.alias("required"))


def error_codes(found: DataFrame) -> DataFrame:
    """(source, table, line, code, meaning) of the error codes that whole tables document.

    The column is the first headed exactly, else in part, as one of error codes; a header that may mean anything counts in an error section only. Any row
    whose code has not the shape of one voids its table, but for headings: rows with nothing beside what is no code.
    """
    bare = F.transform("header", lambda h: F.lower(_bare(h)))
    first = lambda test: F.get(F.filter(F.transform(bare, lambda h, i: F.when(test(h), i)), lambda i: i.isNotNull()), F.lit(0))
    section = F.exists("headings", lambda h: _holds(F.lower(h), ERROR_SECTIONS))
    column = F.coalesce(first(lambda h: h.isin(ERROR_HEADERS)), first(lambda h: _holds(h, ERROR_HEADERS)), F.when(section, first(lambda h: h.isin(AMBIGUOUS_HEADERS))))
    mine = found.where(F.size("header") >= 2).withColumn("at", column).where("at is not null")
    code = lambda r: _bare(F.get(r["cells"], F.col("at")))
    shaped = lambda r: F.coalesce(code(r).rlike(ERROR_CODE), F.lit(False))
    kept = F.filter("body", lambda r: ~(_blank(r["cells"], F.col("at")) & ~shaped(r) & (F.size(r["cells"]) > F.col("at"))))
    whole = mine.withColumn("body", kept).where(F.forall("body", shaped))
    rows = whole.select("source", F.col("line").alias("table"), "at", F.posexplode("body").alias("pos", "row"))
    rest = F.filter(F.col("row.cells"), lambda c, i: i != F.col("at"))
    return rows.select("source", "table", "row.line", _bare(F.get("row.cells", F.col("at"))).alias("code"), F.coalesce(F.get(rest, F.lit(0)), F.lit("")).alias("meaning"))
