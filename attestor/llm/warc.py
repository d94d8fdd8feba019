"""Legacy ARC archives converted to WARC, written and streamed back by Spark's text source."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.session import Workspace

CRLF = "\r\n"
END = CRLF + CRLF
MIN_DEDUP_BYTES = 100
#: Bytes after which an archive is closed; a larger page has an archive of its own.
ARCHIVE_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header fields of an ARC record by version of the format.
ARC_FIELDS = {
    "1": ["url", "ip", "date", "type", "length"],
    "2": ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}
#: The titles of those fields in a version block.
ARC_TITLES = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}
RECORD = "archive string, offset long, record_id string, warc_type string, target_uri string, warc_date string, ip string, content_type string, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string"
READ = "file string, offset long, record_id string, warc_type string, target_uri string, warc_date string, source string, refers_to string, head string, payload_bytes long, payload_digest string, payload binary"


def _inflate(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file, plain or compressed: fields by name, ``offset`` and ``block``.

    The version block names the version, which fixes the fields of every later header line; URLs may hold
    spaces, so fields are taken from the right. A declared length beyond the end is an error.
    """
    data, at, fields = _inflate(content), 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if fields is None:
            if not line.startswith("filedesc:"):
                raise ValueError("no version block")
            size = int(line.rsplit(" ", 1)[1])
            block = data[end + 1 : end + 1 + size]
            version = block.split(b" ", 1)[0].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
            fields = ARC_FIELDS[version]
            values = {"url": line.split(" ", 1)[0], "type": "text/plain", "date": line.split(" ")[2], "ip": line.split(" ")[1], "length": size}
        else:
            parts = line.rsplit(" ", len(fields) - 1)
            if len(parts) != len(fields):
                raise ValueError(f"header line of {len(parts)} fields at {at}")
            values = dict(zip(fields, parts, strict=True))
            size = int(values["length"])
            block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"declared {size} bytes at {at}, found {len(block)}")
        yield values | {"offset": at, "block": block}
        at = end + 1 + size


def to_record(archive: str, arc: dict) -> dict:
    """The WARC record that stands for an ARC record: type, identifier, timestamp and digests.

    Identifiers are name-based (archive and offset), so a task that runs twice gives the same ones.
    """
    url, date, block = arc["url"], arc["date"].ljust(14, "0")[:14], arc["block"]
    head, payload, kind, mime = b"", block, "resource", arc["type"]
    if url.startswith("filedesc:"):
        kind, mime = "warcinfo", "application/warc-fields"
    elif block[:5] == b"HTTP/":
        cut = block.find(b"\r\n\r\n")
        cut = len(block) if cut < 0 else cut + 4
        head, payload, kind, mime = block[:cut], block[cut:], "response", "application/http; msgtype=response"
    return {
        "archive": archive,
        "offset": arc["offset"],
        "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{arc["offset"]}')}",
        "warc_type": kind,
        "target_uri": url,
        "warc_date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z",
        "ip": arc["ip"],
        "content_type": mime,
        "head": head,
        "payload": payload,
        "payload_bytes": len(payload),
        "payload_digest": hashlib.sha256(payload).hexdigest(),
        "block_digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
    }


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 400 + len(row.get("payload") or b"")
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def convert_arc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ARC archives (``archive`` string, ``content`` binary, plain or gzip) as WARC records.

    Version 1 and 2 headers; HTTP responses become ``response``, other blocks ``resource``, version blocks
    ``warcinfo``. Null content and an empty file hold no records; a malformed archive raises. Without
    ``with_payload`` the payload column is null (lengths and digests stay), for cheap passes.
    Other columns are ignored; repeated archives give repeated records.
    """
    schema = _arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for name, content in zip(batch.column(0), batch.column(1), strict=True):
                    for arc in parse_arc(content.as_py() or b""):
                        record = to_record(name.as_py() or "", arc)
                        yield record if with_payload else record | {"payload": None}

        yield from _batches(rows(), schema)

    return archives.select("archive", "content").mapInArrow(run, RECORD)


def arc_archives(df: DataFrame, url: Column, body: Column, version: Column, headers: dict[str, Column] | None = None, date: str = "20240101000000", label: str = "pages", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """ARC archives (``archive``, ``content``) that hold every row of ``df`` as an HTTP response.

    ``url``, ``body`` (string columns) and ``version`` (1 or 2). Each partition fills an archive of either version
    until ``archive_bytes``, and opens the next; names count partitions and archives, so they are unique, and every
    row has a record of its own whatever it repeats. ``headers`` become HTTP header lines (null: none). Null
    urls become ``urn:none``, white space in them is percent-encoded, a null body is empty, a null version is 2.
    """
    spaces = F.regexp_replace(F.coalesce(url, F.lit("urn:none")), r"\s", "%20")
    text = F.coalesce(body, F.lit(""))
    more = [F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF)), F.lit("")) for k, v in (headers or {}).items()]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}"), *more, F.lit("Content-Length: "), F.octet_length(text), F.lit(END), text)
    rows = df.select(F.coalesce(version.cast("int"), F.lit(2)).alias("version"), spaces.alias("url"), http.cast("binary").alias("block"))

    def head(name: str, kind: int) -> bytes:
        block = f"{kind} 0 attestor\n{' '.join(ARC_TITLES[f] for f in ARC_FIELDS[str(kind)])}\n"
        extra = "" if kind == 1 else f"200 - - 0 {name} "
        return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(block)}\n{block}\n".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, names, parts, sizes = TaskContext.get().partitionId(), {1: 0, 2: 0}, {}, {}, {}

        def close(kind: int) -> pa.RecordBatch:
            made[kind] += 1
            return pa.RecordBatch.from_arrays([pa.array([names.pop(kind)]), pa.array([b"".join(parts.pop(kind))], pa.binary())], ["archive", "content"])

        for batch in batches:
            for kind, address, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind not in names:
                    names[kind] = f"{label}-{task:06d}-{made[kind]:06d}-v{kind}.arc"
                    parts[kind], sizes[kind] = [head(names[kind], kind)], 0
                data = block.as_py()
                extra = "" if kind == 1 else f"200 - - 0 {names[kind]} "
                parts[kind] += [f"{address} 0.0.0.0 {date} text/html {extra}{len(data)}\n".encode(), data, b"\n"]
                sizes[kind] += len(data)
                if sizes[kind] >= archive_bytes:
                    yield close(kind)
        for kind in list(names):
            yield close(kind)

    return rows.mapInArrow(run, "archive string, content binary")


def first_copies(records: DataFrame, order: str, work: Workspace, least: int = MIN_DEDUP_BYTES) -> DataFrame:
    """(record_id, first_id, first_order) of records whose payload of at least ``least`` bytes an earlier record has.

    Earlier is a smaller ``order``, ties by record_id; null orders come last. The copies of a payload meet in a
    pre-aggregated minimum, which is written before it is joined: so both sides of the join are plain exchanges, which adaptive
    execution splits for a hot payload.
    """
    large = records.where((F.col("payload_bytes") >= least) & (F.col("warc_type") != "warcinfo")).select("record_id", "payload_digest", F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("order"), "record_id").alias("rank"))
    large = work.save(large, "large")
    firsts = work.save(large.groupBy(F.col("payload_digest").alias("digest")).agg(F.min("rank").alias("first")), "firsts")
    met = large.join(firsts, large.payload_digest == firsts.digest)
    return met.where(F.col("record_id") != F.col("first.record_id")).select("record_id", F.col("first.record_id").alias("first_id"))


def write_warc(records: DataFrame, revisits: DataFrame, path: str, records_per_file: int = 4000) -> None:
    """Write ``records`` as compressed WARC files under ``path``; those in ``revisits`` carry headers only.

    Spark's text writer with a line separator of two CRLF, which is what ends a WARC record, so the files
    are committed like any table on any file system. A file holds at most ``records_per_file`` records and
    never more than one task writes; readers stream it.
    """
    links = revisits.select(F.col("record_id").alias("copy_id"), "first_id")
    full = records.join(links, records.record_id == links.copy_id, "left")
    again = F.col("first_id").isNotNull()
    block = F.when(again, F.coalesce(F.col("head").cast("string"), F.lit(""))).otherwise(F.concat(F.col("head").cast("string"), F.col("payload").cast("string")))

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    wide = full.withColumn("block", block)
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.col("warc_type"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), F.col("first_id"), F.lit(">"))))).otherwise(line("WARC-Block-Digest", F.col("block_digest"))),
        line("X-Source-Archive", F.concat(F.col("archive"), F.lit("#"), F.col("offset"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length("block")),
        F.lit(CRLF),
        F.col("block"),
    )
    wide.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(chunks: Iterable[bytes]) -> Iterator[dict]:
    """Records of a WARC file read chunk by chunk: ``headers`` (lower-case names), ``offset`` and ``block``.

    One record is held at a time, whatever the size of the file. A record that does not end where it declares raises.
    """
    held, size, need, at = [], 0, 0, 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size < need:
            continue
        data, start = b"".join(held), 0
        while True:
            end = data.find(b"\r\n\r\n", start)
            if end < 0:
                need = 0
                break
            if not data.startswith(b"WARC/", start):
                if not data[start:].strip(b"\r\n"):  # an end of line or two may follow the last record
                    break
                raise ValueError(f"no WARC record at {at + start}")
            lines = data[start:end].decode("utf-8", "replace").split(CRLF)
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            stop = end + 4 + int(headers["content-length"])
            if stop + 4 > len(data):
                need = stop + 4 - start
                break
            if data[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError(f"record at {at + start} does not end where it declares")
            yield {"headers": headers, "offset": at + start, "block": data[end + 4 : stop]}
            start = stop + 4
        held, at = [data[start:]], at + start
        size = len(held[0])
    if b"".join(held).strip(b"\r\n"):
        raise ValueError(f"record at {at} does not end where it declares")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the WARC files under ``path`` (plain, or .gz of any number of members); a payload that belies its digest raises.

    The files are streamed by Spark's text reader, cut at two CRLF and put together again by declared lengths. A packed file is
    read by one task. A plain one may be split among several, so its lines are dealt out by file and sorted by split and place.
    A revisit has no payload of its own: length and digest are those its headers state. ``head`` is the HTTP header.
    """
    schema = _arrow_schema(READ)

    def read(name: str, record: dict) -> dict:
        h, block = record["headers"], record["block"]
        kind, head, payload = h["warc-type"], None, block
        if h.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            head, payload = block if cut < 0 else block[:cut], b"" if cut < 0 else block[cut + 4 :]
        digest, size = h.get("warc-payload-digest", "").removeprefix("sha256:"), len(payload)
        if kind == "revisit":
            payload, size = None, int(h["x-payload-length"])
        else:
            found = hashlib.sha256(payload).hexdigest()
            if digest and digest != found:
                raise ValueError(f"{h['warc-record-id']}: payload does not match its digest")
            digest = found
        return {
            "file": name, "offset": record["offset"], "record_id": h["warc-record-id"].strip("<>"), "warc_type": kind, "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"),
            "source": h.get("x-source-archive"), "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, "head": None if head is None else head.decode("utf-8", "replace"),
            "payload_bytes": size, "payload_digest": digest, "payload": payload if with_payload else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1), strict=True)

        def rows():
            for name, mine in groupby(pieces(), key=lambda x: x[0]):
                for record in parse_warc(piece.as_py() + b"\r\n\r\n" for _, piece in mine):
                    yield read(name, record)

        yield from _batches(rows(), schema)

    lines = spark.read.option("lineSep", END).text(path)
    whole = T.StructType.fromDDL(READ)
    named = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))
    packed = F.lower("file").endswith(".gz")
    plain = named.where(~packed).repartition("file").sortWithinPartitions("file", "split", "place")
    return named.where(packed).select("file", "line").mapInArrow(run, whole).unionAll(plain.select("file", "line").mapInArrow(run, whole))
