"""Chat formatting into budgeted windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
#: (control string, what stands for it): the escape character first, so that undoing runs in reverse.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]
ROLE_ESCAPES = [(":", "\\c"), ("\n", "\\n")]
CHARS_PER_TOKEN = 4


def escape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for raw, safe in reversed(pairs):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_conversations(
    df: DataFrame,
    budget: int = 2048,
    history: int = 256,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokens_col: str | None = None,
) -> DataFrame:
    """Windows of formatted turns: (conv_id, window, formatted, n_repeated, loss_spans).

    A turn is written ``### role: text</turn>`` and a newline, with control strings in role and text escaped
    reversibly. Turn tokens (``tokens_col``, else a quarter of the characters written) are summed along
    each conversation, and the sum before a turn chooses its window, so windows hold whole turns: their
    new turns start within half of what ``budget`` leaves beside ``history``. Every later window first
    repeats the conversation's first system turn, then the turns of the window before that start
    within ``history`` tokens of its end. ``loss_spans`` has the (start, length) in code points of each new
    assistant text; what is repeated (the first ``n_repeated`` turns) and all other roles carry no loss.
    A window exceeds the budget only by a system turn or a single turn that is itself too long.

    Null roles and texts count as empty, a null conv_id is a conversation of its own, null turns come first;
    ties in ``turn`` are ordered by role, then text; repeated rows are turns of their own; other columns
    are ignored; an empty table gives no windows. One shuffle, by conversation.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ESCAPES + ROLE_ESCAPES), F.lit(SEP))
    turns = (
        df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), *([F.col(tokens_col).alias("tokens")] if tokens_col else []))
        .withColumns({"head": F.length(head), "body": F.length(escape(F.col("text"))), "line": F.concat(head, escape(F.col("text")), F.lit(CLOSE))})
        .withColumn("chars", F.length("line").cast("long"))
    )
    if not tokens_col:
        turns = turns.withColumn("tokens", F.ceil(F.col("chars") / CHARS_PER_TOKEN))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    stride = max(1, (budget - history) // 2)
    turns = turns.withColumns({"ord": F.row_number().over(order), "start": F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")})
    turns = turns.withColumn("window", F.floor(F.col("start") / stride).cast("long"))
    inside = W.partitionBy("conv_id", "window").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum("chars").over(inside), F.lit(0)).cast("long"))
    turn = F.struct("ord", "start", "line", "chars", (F.col("role") == "system").alias("is_system"), (F.col("role") == "assistant").alias("learn"), "at", "head", "body")
    spans = turns.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("new"))

    along = W.partitionBy("conv_id").orderBy("window")
    own_system = F.try_element_at(F.filter("new", lambda t: t.is_system), F.lit(1))
    spans = spans.withColumns({
        "system": F.first(own_system, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)),
        "previous": F.lag("new").over(along),
    })
    first = F.col("new")[0].start
    none = F.slice("new", 1, 0)
    recalled = F.filter(F.coalesce("previous", none), lambda t: (t.start >= first - history) & ~F.coalesce(t.ord == F.col("system").ord, F.lit(False)))
    repeated = F.concat(F.when(F.col("system").isNotNull(), F.array("system")).otherwise(none), recalled)
    spans = spans.withColumn("repeated", repeated)
    shift = F.aggregate("repeated", F.lit(0).cast("long"), lambda n, t: n + t.chars)
    spans = spans.withColumn("shift", shift)
    learned = F.transform(F.filter("new", lambda t: t.learn), lambda t: F.struct((F.col("shift") + t["at"] + t.head).alias("start"), t.body.cast("long").alias("length")))
    return spans.select(
        "conv_id",
        "window",
        F.array_join(F.transform(F.concat("repeated", "new"), lambda t: t.line), "").alias("formatted"),
        F.size("repeated").alias("n_repeated"),
        learned.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted window."""
    lines = F.filter(F.split(formatted, F.lit("</turn>\n"), -1), lambda x: x != "")
    role = F.regexp_extract
    return F.transform(
        lines,
        lambda x: F.struct(
            unescape(role(x, "(?s)^### ([^:]*): ", 1), ESCAPES + ROLE_ESCAPES).alias("role"),
            unescape(F.regexp_replace(x, "(?s)^### [^:]*: ", "")).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """Array of the unescaped texts under the loss mask."""
    return F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int"))))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation what ``windows`` hold, read from the formatted text alone and counting no turn twice."""
    turns = read_turns(F.col("formatted"))
    new = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns), F.lit(1)))
    read = windows.select("conv_id", "window", F.length("formatted").cast("long").alias("chars"), new.alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    per = read.select(
        "conv_id", "window", "chars", F.size("turns").cast("long").alias("n"), "loss",
        F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("plain"),
    )
    out = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "plain", "loss"))).alias("parts"))
    plain, loss = F.array_join("parts.plain", ""), F.array_join("parts.loss", "")
    return out.select("conv_id", "n_turns", F.sha2(plain, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


CONV_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
