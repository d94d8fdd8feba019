"""Source manifests: formats, excludes, duplicates, authority, coverage (S01-S06, V02, W01, J-EQ4, J-EQ5, J-EQ11, G13)."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attestor.session import Workspace

#: File endings and the format each stands for.
FORMATS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "docx": "word", "doc": "word_legacy", "xlsx": "spreadsheet", "xls": "spreadsheet", "txt": "plain_text", "csv": "csv", "json": "openapi_json", "yaml": "openapi_yaml", "yml": "openapi_yaml", "html": "html", "htm": "html"}
#: Formats that are recognised but can't be read.
UNSUPPORTED = ["unknown", "word_legacy", "spreadsheet", "plain_text", "csv"]
#: Files that are never a source.
EXCLUDES = ["README*", "LICENSE*", "LICENCE*", "CHANGELOG*", "CONTRIBUTING*", ".DS_Store", ".git/*", "*.source.json"]


def file_format(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))), F.lit("unknown"))


def is_excluded(path: Column, patterns: list[str] | None = None) -> Column:
    """Whether a glob matches the whole path or its last part."""
    regex = "|".join(f"(?:{fnmatch.translate(p).replace(chr(92) + 'z', '$').replace(chr(92) + 'Z', '$')})" for p in (EXCLUDES if patterns is None else patterns))
    if not regex:
        return F.lit(False)
    return path.rlike(f"^(?:{regex})") | F.regexp_extract(path, "([^/]*)$", 1).rlike(f"^(?:{regex})")


def with_status(files: DataFrame, path: str = "path", sha: str = "sha256", readable: str | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Add ``format``, ``status`` and ``duplicate_of``: the first supported file of each hash by path is pending, later ones duplicate it.

    Excluded files are ignored, unreadable and unsupported ones say so; none of these is ever what another duplicates.
    The copies of a hash meet in a pre-aggregated minimum, so that a hot hash is no window in one task.
    """
    status = F.when(is_excluded(F.col(path), excludes), "ignored")
    if readable:
        status = status.when(~F.col(readable), "unreadable")
    marked = files.withColumn("format", file_format(F.col(path)))
    marked = marked.withColumn("status", status.when(F.col("format").isin(UNSUPPORTED), "unsupported"))
    firsts = marked.where("status is null").groupBy(F.col(sha).alias("__sha")).agg(F.min(path).alias("__first"))
    met = marked.join(firsts, F.col(sha) == F.col("__sha"), "left").drop("__sha")
    later = F.col("status").isNull() & (F.col(path) != F.col("__first"))
    return met.withColumns({"duplicate_of": F.when(later, F.col("__first")), "status": F.coalesce("status", F.when(later, "duplicate").otherwise("pending"))}).drop("__first")


def scan_directory(spark, root: str) -> DataFrame:
    """(path, size_bytes, sha256) of the files under ``root``, by Spark's binary reader, which leaves out files without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/") + "/"
    return files.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).withColumn("path", F.regexp_replace("path", "^" + prefix.replace(".", r"\."), ""))


def with_authority(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Add ``authority`` from each file's sidecar (path, content): normative without one, and a broken or foreign sidecar raises."""
    side = sidecars.select(F.regexp_replace("path", r"\.source\.json$", "").alias("__path"), F.col("content").alias("__content"))
    parsed = F.from_json("__content", "authority string, source_file string, sha256 string", {"mode": "PERMISSIVE"})
    met = files.join(side, F.col("path") == F.col("__path"), "left").withColumn("__side", parsed)
    wrong = F.col("__content").isNotNull() & (F.try_parse_json("__content").isNull() | ~F.coalesce(F.col("__side.sha256") == F.col("sha256"), F.lit(True)) | ~F.coalesce(F.col("__side.source_file") == F.regexp_extract("path", "([^/]*)$", 1), F.lit(True)))
    value = F.when(wrong, F.raise_error(F.concat(F.lit("bad sidecar of "), F.col("path")))).when(F.col("__side.authority").isNotNull(), "supplementary").otherwise("normative")
    return met.withColumn("authority", value).drop("__path", "__content", "__side")


#: Digests that one digest above them covers.
FANOUT = 1024


def binding_digest(manifest: DataFrame) -> DataFrame:
    """One row: a digest over the manifest's rows in path order (V02), by a tree of digests of FANOUT each, so that no row holds them all."""
    one = F.sha2(F.to_json(F.struct("path", "sha256", "status", "duplicate_of"), {"ignoreNullFields": "false"}), 256)
    level = row_numbers(manifest.select("path", one.alias("d")), ["path", "d"], "n").select((F.col("n") - 1).cast("long").alias("n"), "d")
    size = level.count()
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "d"))), lambda x: x.d), "\n")
        level = level.groupBy(F.floor(F.col("n") / FANOUT).cast("long").alias("n")).agg(F.sha2(joined, 256).alias("d"))
        size = -(-size // FANOUT)
        if size <= 1:
            break
    return level.agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("binding_digest"))


def never_fetched(expected: DataFrame, results: DataFrame, url: str = "url") -> DataFrame:
    """Distinct expected pages without a result of any status (J-EQ4)."""
    from attestor.functions.urls import page_url

    want = expected.select(page_url(F.col(url)).alias("url")).where("url is not null").distinct()
    return want.join(results.select(page_url(F.col(url)).alias("url")), "url", "left_anti")


def unreferenced_sources(manifest: DataFrame, citations: DataFrame) -> DataFrame:
    """Pending sources that nothing cites (J-EQ5)."""
    return manifest.where("status = 'pending'").join(citations.select(F.col("source").alias("path")), "path", "left_anti")


def ledger_files(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Add the one file whose path is or ends in the ledger's file name; null if none or several do (J-EQ11).

    An equi-join on every path suffix, so that it needs no pattern join.
    """
    parts = F.split("path", "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    ends = files.select("path", F.explode(suffix).alias("__suffix"))
    found = ledger.join(ends, F.col("file") == F.col("__suffix"), "left").groupBy(*ledger.columns).agg(F.count_distinct("path").alias("__n"), F.min("path").alias("snapshot_file"))
    return found.withColumn("snapshot_file", F.when(F.col("__n") == 1, F.col("snapshot_file"))).drop("__n")


def rollup_status(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Rows per status at every level of ``keys`` in one pass."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(status) == "pending").alias("n_pending"), F.count_if(F.col(status) == "duplicate").alias("n_duplicate"))


def row_numbers(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number rows from 1 in order: ranges of the order are written, and each adds the counts of the ranges before it."""
    work = Workspace(rows.sparkSession, "numbers")
    ranges = work.save(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__range"), (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__own", own).join(F.broadcast(before), "__range").select(*rows.columns, (F.col("__own") + F.col("__before")).alias(out))


def sequential_ids(rows: DataFrame, prefix: str, order: list[str], width: int = 3, out: str = "id", within: list[str] | None = None) -> DataFrame:
    """Ids ``prefix`` 001, 002 … in order inside each group; longer numbers keep all their digits."""
    numbered = rows.withColumn("__id", F.row_number().over(W.partitionBy(*within).orderBy(*order))) if within else row_numbers(rows, order, "__id")
    return numbered.withColumn(out, F.concat(F.lit(prefix), F.format_string(f"%0{width}d", "__id"))).drop("__id")


def occurrence_keys(rows: DataFrame, key: str, order: str, out: str = "key") -> DataFrame:
    """Repeated keys get ``#2``, ``#3`` … in order."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.withColumn(out, F.when(n > 1, F.concat(F.col(key), F.lit("#"), n)).otherwise(F.col(key)))
