"""JSON functions: canonical text (F06), pointers (F08), legacy locators (F09), leaves (N08, J01), blocks in prose."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, numbers as written (1 and 1.0 differ); null if it is no JSON."""
    return text.map(_canonical)


def pointer_escape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(segment: Column) -> Column:
    """The raw segment; a tilde that starts no escape raises."""
    return F.when(segment.rlike("~(?![01])"), F.raise_error(F.lit("malformed pointer escape"))).otherwise(F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def legacy_locator(raw: Column) -> Column:
    """The kind and values of a free-text locator; what fits no form is unresolved."""
    text = F.trim(raw)
    number = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("int")
    page, lines = r"(?i)^page\s+(\d+)$", r"(?i)^lines?\s+(\d+)(?:\s*-\s*(\d+))?$"
    kind = F.when(text.rlike(page), "page").when(text.rlike(lines), "lines").when(text.startswith("/") | text.startswith("#/"), "pointer").when(text.startswith("css:"), "css").when(text.startswith("xpath:"), "xpath").when(F.lower(text).startswith("section:"), "section").otherwise("unresolved")
    start = number(lines, 1)
    return F.struct(
        kind.alias("kind"),
        number(page, 1).alias("page"),
        start.alias("start_line"),
        F.coalesce(number(lines, 2), start).alias("end_line"),
        F.when(kind == "section", F.transform(F.split(F.regexp_replace(text, "(?i)^section:", ""), ">"), lambda x: F.trim(x))).alias("heading_path"),
        F.when(kind == "pointer", F.regexp_replace(text, "^#", "")).alias("pointer"),
        F.when(kind.isin("css", "xpath"), F.regexp_replace(text, "^(css|xpath):", "")).alias("selector"),
    )


def _leaves(node, path: str, out: list) -> None:
    stack = [(node, path)]
    while stack:
        value, at = stack.pop()
        if isinstance(value, dict) and value:
            stack += [(v, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}") for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            stack += [(v, f"{at}/{i}") for i, v in reversed(list(enumerate(value)))]
        else:
            out.append((at, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))


def json_leaves(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """A row (*keep, ordinal, path, value) for each leaf of a JSON column; nulls and broken JSON give none."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name in keep], T.StructField("ordinal", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])
    names = [f.name for f in schema.fields[:-3]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for record in frame.itertuples(index=False):
                try:
                    node = json.loads(record[-1]) if record[-1] is not None else None
                except ValueError:
                    node = None
                if node is None:
                    continue
                found: list = []
                _leaves(node, "", found)
                rows += [(*record[:-1], i, p, v) for i, (p, v) in enumerate(found)]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(*names, json_col).mapInPandas(run, schema)


def _block(text: str | None) -> str | None:
    """The first fenced or bare balanced JSON object of a text."""
    if text is None:
        return None
    decoder, starts = json.JSONDecoder(), []
    fence = text.find("```json")
    if fence >= 0:
        starts.append(text.find("{", fence))
    starts.append(text.find("{"))
    for at in starts:
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
            except ValueError:
                at = text.find("{", at + 1)
                continue
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def json_block(text: pd.Series) -> pd.Series:
    return text.map(_block)
