"""Snapshots of changed sources, their check against the files that hold them, and the review that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a reviewer has to do, in order, by kind of trigger.
STEPS = {
    "source_changed": [
        "Review the retained source bytes against the changed-source trigger.",
        "Re-extract into a separate work directory and run verify-extraction.",
        "Assemble, inspect the impact diff, then request explicit human approval.",
    ],
    "freshness_inconclusive": [
        "Investigate the inconclusive freshness result before re-extraction.",
        "Do not assemble or approve until source availability is resolved.",
    ],
}


def snapshot_sources(observations: DataFrame) -> DataFrame:
    """(label, id, sha256, path, content, error): the changed sources of a scan (label, id, status, sha256, raw) under names made of their bytes.

    A source whose bytes were not kept, or have another digest than the scan says, has an error and no content.
    """
    digest = F.sha2("raw", 256)
    error = F.when(F.col("raw").isNull() | F.col("sha256").isNull(), "not retained").when(digest != F.col("sha256"), "digest mismatch")
    changed = observations.where("status = 'changed'").withColumn("error", error)
    good = F.col("error").isNull()
    return changed.select("label", "id", F.when(good, F.col("sha256")).alias("sha256"), F.when(good, F.concat(F.lit("sources/"), "sha256", F.lit(".source"))).alias("path"), F.when(good, F.col("raw")).alias("content"), "error")


def landed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of all files below a folder, their bytes read and digested where they lie. Spark reads no file without bytes, so such a one is not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.substring_index("path", root.rstrip("/") + "/", -1)
    return files.select(at.alias("path"), F.sha2("content", 256).alias("sha256"))


def verify_files(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """(path, expected, found, state) of every path of a ledger (path, sha256) or among the files (path, sha256).

    ``verified``, ``digest_mismatch`` (also where the ledger itself names two digests), ``missing`` or ``unlisted``. Both sides
    meet once by path; repeated rows count once.
    """
    told = ledger.groupBy("path").agg(F.min("sha256").alias("expected"), (F.min("sha256") == F.max("sha256")).alias("single"))
    there = files.groupBy("path").agg(F.min("sha256").alias("found"))
    met = told.withColumn("listed", F.lit(True)).join(there.withColumn("held", F.lit(True)), "path", "full_outer")
    same = F.coalesce(F.col("single") & (F.col("expected") == F.col("found")), F.lit(False))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(same, "verified").otherwise("digest_mismatch")
    return met.select("path", "expected", "found", state.alias("state"))


def review_plan(triggers: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """(label, kind, reason, sources, steps, error) for every trigger (label, kind, reason), over a snapshot's ledger (label, id, sha256, path) and files.

    Sources are those of the label in order of id. A changed trigger is refused where the snapshot has no source for it, and any
    trigger where a source of its label is missing or has other bytes; ``error`` says so and its steps are null.
    """
    checked = ledger.join(verify_files(ledger, files).select("path", "state"), "path", "left")
    held = checked.groupBy("label").agg(F.array_sort(F.collect_set(F.struct("id", "sha256", "path"))).alias("sources"), F.min(F.when(F.col("state") != "verified", F.concat_ws(": ", "state", "path"))).alias("bad"))
    met = triggers.join(held, "label", "left")
    error = F.coalesce("bad", F.when((F.col("kind") == "source_changed") & F.col("sources").isNull(), "no verified snapshot"))
    steps = F.when(F.col("kind") == "source_changed", F.array(*map(F.lit, STEPS["source_changed"]))).otherwise(F.array(*map(F.lit, STEPS["freshness_inconclusive"])))
    return met.select("label", "kind", "reason", F.coalesce("sources", F.array().cast("array<struct<id:string,sha256:string,path:string>>")).alias("sources"), F.when(error.isNull(), steps).alias("steps"), error.alias("error"))
