"""Signatures of integration contracts: words that tell of one, mechanisms that can be run, examples that leave them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Words that tell of encryption or signatures; the first of them that a contract's notes hold is named.
SIGNAL_WORDS = ["加密", "簽章", "AES", "HashKey", "HashIV", "SHA256"]
#: Purposes of mechanisms that sign requests (or none stated), and the examples that could call them.
PURPOSES = ["request", "signature"]
EXAMPLES = r"request\.(ts|py)$"
#: A quoted name before a colon; it may start inside another match, so only its first quote is consumed.
DECLARED = r"""(?U)['"](?=([^'"]+)['"]\s*:)"""
WIRED = r"""(?U)\[['"]([^'"]+)['"]\]\s*=\s*sign\w*\("""


def signal_gaps(notes: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """(run, word) of runs whose notes (run, text) hold a signal word although the run has no mechanism (run).

    Each note is looked through once, where it lies, and a run keeps the least place in SIGNAL_WORDS: no run's notes are
    gathered. Null notes hold none.
    """
    first = F.coalesce(*[F.when(F.col("text").contains(w), F.lit(i)) for i, w in enumerate(SIGNAL_WORDS)])
    hits = notes.select("run", first.alias("place")).where("place is not null").groupBy("run").agg(F.min("place").alias("place"))
    return hits.join(mechanisms.select("run").distinct(), "run", "left_anti").select("run", F.element_at(F.array(*map(F.lit, SIGNAL_WORDS)), F.col("place") + 1).alias("word"))


def is_runnable(algorithm: Column, mode: Column, steps: Column) -> Column:
    """Whether code can be written for a mechanism: AES in CBC mode, by its mode or else by its algorithm, with stated steps."""
    name, way = F.upper(F.coalesce(algorithm, F.lit(""))), F.upper(F.coalesce(mode, F.lit("")))
    return name.rlike("(^|[^A-Z0-9])AES([^A-Z0-9]|$)") & F.when(way != "", way == "CBC").otherwise(name.contains("CBC")) & (F.coalesce(steps, F.lit(0)) > 0)


def unwired_fields(examples: DataFrame) -> DataFrame:
    """(run, path, field) of the keys that an example (run, path, content) of a request declares but never takes from a signature."""
    own = examples.where(F.col("path").rlike(EXAMPLES))
    left = F.array_except(F.regexp_extract_all("content", F.lit(DECLARED), 1), F.regexp_extract_all("content", F.lit(WIRED), 1))
    return own.select("run", "path", F.explode(left).alias("field"))


def signature_findings(schemes: DataFrame, examples: DataFrame) -> DataFrame:
    """(run, label, location, code) of signature mechanisms that name no field, or whose field an example leaves unsigned.

    ``schemes``: (run, ord, name, purpose, algorithm, mode, steps, field); ``examples``: (run, path, content). Only runnable
    mechanisms that sign requests are judged; one without name goes by its place among them. Keys of an example are found
    in one pass and met with the fields of all mechanisms by equality.
    """
    signing = schemes.where(F.col("purpose").isNull() | F.col("purpose").isin(PURPOSES))
    placed = signing.withColumn("place", F.row_number().over(W.partitionBy("run").orderBy("ord")) - 1)
    judged = placed.where(is_runnable(F.col("algorithm"), F.col("mode"), F.col("steps")))
    named = judged.select("run", F.coalesce(F.nullif("name", F.lit("")), F.col("place").cast("string")).alias("label"), F.nullif("field", F.lit("")).alias("field"))
    silent = named.where("field is null").select("run", "label", F.concat(F.lit("integration.crypto."), "label").alias("location"), F.lit("REQUIRED_INFO_MISSING").alias("code"))
    loose = named.join(unwired_fields(examples), ["run", "field"]).select("run", "label", F.col("path").alias("location"), F.lit("OUTPUT_MISMATCH").alias("code"))
    return silent.unionAll(loose)
