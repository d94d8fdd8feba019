"""Typed artifact tables, their loaders and sinks, and evidence fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.urls import openapi_signal

#: Schemas of the artifacts, as DDL; unknown shapes fail instead of being guessed.
SCHEMAS = {
    "manifest": "relative_path string, mime_type string, source_format string, size_bytes bigint, sha256 string, scanned_at timestamp, supported boolean, status string, duplicate_of string, authority string",
    "url_sources": "url string, fetched_at timestamp, http_status int, content_sha256 string, note string, snapshot_file string",
    "coverage": "url string, status string, file string, method string, provenance_file string, note string",
    "endpoints": "file string, method string, methods array<string>, path string, summary string, source string, parameters array<struct<name: string, `in`: string, type: string, required: boolean, description: string>>, request string, responses array<struct<status: string, description: string, schema_ref: string>>, tags array<string>, security array<string>, examples array<string>, missing array<string>",
    "fragments": "id string, source_artifact_id string, kind string, start_line int, end_line int, pointer string, fragment_digest string, normalized_excerpt string, semantic_value string, semantic_role string, parent_fragment_id string, precision string",
    "issues": "ord int, code string, severity string, location string, evidence string, suggested_fix string, auto_fixable boolean, target_file string, field_path string, requery_scope string",
    "provenance": "target string, status string, manifest_source string, query_id string, answer_path string, locator string",
    "focus": "ord int, id string, kind string, intent string, text string, rationale string",
    "waivers": "id string, claim_identity string, reason string, approved_by string, expires_at timestamp, scope array<string>",
}


def load(spark: SparkSession, path: str, kind: str, multiline: bool = True) -> DataFrame:
    """Read a JSON artifact with its schema; malformed files fail (S25, S26). Adds ``_file``."""
    reader = spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").option("multiLine", multiline)
    return reader.json(path).select("*", F.col("_metadata.file_name").alias("_file"))


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write where nothing is yet; an existing target is an error."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_report(findings: DataFrame, path: str) -> None:
    """A report as JSON lines in order beside its Markdown lines (S27), both written by Spark."""
    rows = findings.sort(*findings.columns)
    rows.write.mode("errorifexists").json(f"{path}/json")
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in findings.columns])
    rows.select(F.concat(F.lit("| "), line, F.lit(" |")).alias("value")).write.mode("errorifexists").text(f"{path}/markdown")


def publish(df: DataFrame, root: str, version: str, expected: str | None = None) -> str:
    """Write an immutable version and make it the current one; the current one must be ``expected``.

    A claim on the step from ``expected`` is a file that is created only if it is not there, which a file system such as HDFS
    does atomically: of two writers that start from one version, one fails.
    """
    spark = df.sparkSession
    if current(spark, root) != expected:
        raise RuntimeError(f"the current version of {root} is not {expected}")
    path = f"{root}/versions/{version}"
    write_once(df, path)
    fs, claim = _path(spark, f"{root}/claims/after-{expected or 'nothing'}")
    if not fs.createNewFile(claim):
        raise RuntimeError(f"the current version of {root} is no longer {expected}")
    spark.range(1).select(F.lit(version).alias("version"), F.lit(expected).cast("string").alias("expected")).write.mode("append").parquet(f"{root}/pointer")
    return path


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, root: str) -> str | None:
    """The version that nothing has followed yet."""
    fs, at = _path(spark, f"{root}/pointer")
    if not fs.exists(at):
        return None
    steps = spark.read.parquet(f"{root}/pointer")
    last = steps.join(steps.select(F.col("expected").alias("version")), "version", "left_anti").first()
    return None if last is None else last[0]


def url_sources(responses: DataFrame, max_bytes: int = 5 << 20) -> DataFrame:
    """Landed responses (url, status, content, error) as URL sources: no hash without success or beyond the limit."""
    ok = F.col("status").between(200, 299) & (F.octet_length("content") <= max_bytes)
    note = F.when(F.col("error").isNotNull(), F.col("error")).when(F.octet_length("content") > max_bytes, "over the size limit").when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), "status"))
    return responses.select("url", F.when(F.col("error").isNull(), F.col("status")).alias("http_status"), F.when(ok & F.col("error").isNull(), F.sha2("content", 256)).alias("content_sha256"), note.alias("note"))


def verified_imports(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    """Imports whose file and hash the manifest confirms; any other raises."""
    m = manifest.select(F.col("relative_path").alias("file"), F.col("sha256").alias("__sha"))
    met = ledger.join(m, "file", "left")
    good = F.coalesce(F.col("__sha") == F.col("sha256"), F.lit(False))
    return met.withColumn("verified", F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("import does not match the manifest: "), "file")))).drop("__sha")


def line_fragments(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """(source, start_line, end_line, excerpt, digest, precision) of requested line ranges (S29); a range beyond the end is unresolved.

    Requests meet their document in one join, and every range is a slice of its lines.
    """
    docs = documents.select("source", F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1).alias("__lines"))
    met = requests.join(docs, "source", "left")
    valid = F.coalesce((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.size("__lines")), F.lit(False))
    excerpt = F.when(valid, F.array_join(F.slice("__lines", F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n"))
    out = met.select("source", "start_line", "end_line", excerpt.alias("excerpt"))
    return out.withColumns({"digest": F.sha2("excerpt", 256), "precision": F.when(F.col("excerpt").isNull(), "unresolved").otherwise("exact")})


def landed_specs(responses: DataFrame, max_bytes: int = 5 << 20) -> DataFrame:
    """(url, status, sha256, version) of landed responses (url, status, body) as specifications to publish (S17): what is no specification, too large or no success says so."""
    signal = openapi_signal(F.col("body"))
    status = F.when(~F.col("status").between(200, 299) | F.col("body").isNull(), "not_fetched").when(F.octet_length("body") > max_bytes, "too_large").when(~signal.is_openapi, "not_a_specification").otherwise("accepted")
    return responses.select("url", status.alias("status"), F.when(status == "accepted", F.sha2("body", 256)).alias("sha256"), F.when(status == "accepted", signal.version).alias("version"))


def supplementary_notes(notes: DataFrame) -> DataFrame:
    """Excerpts that people sent (S19), as files beside their provenance: (path, content, sha256, authority, provenance_path, provenance).

    ``notes``: (file, content, received_from, received_at, excerpted_by, subject). The file is one Markdown name, sender and excerpter are
    named, and the time has an offset; anything else raises, as does a file imported twice. The provenance states the
    instant in UTC, and lower authority.
    """
    at = F.try_to_timestamp("received_at")
    zoned = F.col("received_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    wrong = (
        F.when(~F.coalesce(F.col("file").rlike(r"^[^/\\]+\.(md|markdown)$"), F.lit(False)), "file is no Markdown name").when(F.coalesce(F.trim("received_from"), F.lit("")) == "", "received_from is empty")
        .when(F.coalesce(F.trim("excerpted_by"), F.lit("")) == "", "excerpted_by is empty").when(at.isNull() | ~zoned, "received_at is no time with an offset")
    )
    twice = notes.groupBy(F.col("file").alias("__file")).agg(F.count("*").alias("__n"))
    met = notes.join(twice, F.col("file") == F.col("__file"), "left").withColumn("wrong", F.coalesce(wrong, F.when(F.col("__n") > 1, "file is imported twice")))
    sha = F.sha2("content", 256)
    provenance = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("supplementary").alias("authority"), "received_from", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("received_at"), "subject", "excerpted_by", sha.alias("imported_sha256"), F.col("file").alias("source_file")))
    path = F.when(F.col("wrong").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "wrong"))).otherwise(F.col("file"))
    return met.select(path.alias("path"), "content", sha.alias("sha256"), F.lit("supplementary").alias("authority"), F.concat("file", F.lit(".source.json")).alias("provenance_path"), provenance.alias("provenance"))


def prepared_documents(files: DataFrame) -> DataFrame:
    """Files (path, content) as they are prepared for reading (S20): (path, output, kind, content).

    Texts are decoded with what is broken replaced; all else passes byte for byte. PDF and Word files are converted
    elsewhere, so here they are ``unconverted`` under the name their Markdown would have. Two files that claim one output raise.
    """
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ending.isin("pdf", "docx"), "unconverted").when(ending.isin("md", "markdown", "txt", "html", "htm", "json", "yaml", "yml", "csv"), "text").otherwise("passthrough")
    named = files.withColumns({"kind": kind, "output": F.when(ending.isin("pdf", "docx"), F.concat("path", F.lit(".md"))).otherwise(F.col("path"))})
    claims = named.groupBy(F.col("output").alias("__output")).agg(F.count_distinct("path").alias("__n"))
    met = named.join(claims, F.col("output") == F.col("__output"))
    output = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("several files map to "), "output"))).otherwise(F.col("output"))
    content = F.when(F.col("kind") == "text", F.encode(F.make_valid_utf8(F.col("content").cast("string")), "UTF-8")).otherwise(F.col("content"))
    return met.select("path", output.alias("output"), "kind", content.alias("content"))
