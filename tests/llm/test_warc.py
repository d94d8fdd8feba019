from __future__ import annotations

import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestor.llm import queries, warc
from attestor.session import Workspace

PAGES = [(1, "http://a.b/x y", "<p>" + "long " * 40 + "</p>"), (2, None, "<p>" + "long " * 40 + "</p>"), (3, "http://c", None), (4, "http://c", ""), (5, "http://d", "short"), (6, "http://d", "short"), (7, "http://e", "body\r\n\r\nWARC/1.1\r\n\r\nmore é" * 20), (8, "http://f", "z" * 2_000_000), (9, "http://g", "<p>" + "long " * 40 + "</p>")]


def archive(spark, rows, **args):
    df = spark.createDataFrame([(*r, "clash", "x") for r in rows], "page_id long, url string, html string, archive string, content string").repartition(2, "page_id")
    return warc.arc_archives(df, F.col("url"), F.col("html"), F.when(F.col("page_id") % 2 == 0, 1).otherwise(2), {"X-Page-Id": F.col("page_id")}, **args)


def page_of(column):
    return F.regexp_extract(F.concat(F.col(column).cast("string"), F.lit("\r\n")), r"\r\nX-Page-Id: (-?\d+)\r\n", 1).try_cast("long")


@pytest.mark.parametrize("archive_bytes", [1, 700, 1 << 20])
def test_round_trip(spark, archive_bytes):
    work = Workspace(spark, "warctest")
    archives = work.save(archive(spark, PAGES, archive_bytes=archive_bytes), "arc")
    if archive_bytes > 1:
        assert archives.count() < len(PAGES)
    records = warc.convert_arc(archives).withColumn("order", page_of("head"))
    path = work.new_path("warc")
    warc.write_warc(records, warc.first_copies(records, "order", work), path, records_per_file=3)
    rows = {r.page: r for r in warc.read_warc(spark, path).where("warc_type != 'warcinfo'").withColumn("page", page_of("head")).collect()}
    assert len(rows) == len(PAGES)
    for page, url, html in PAGES:
        data, r = (html or "").encode(), rows[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.warc_type == ("revisit" if page in (2, 9) else "response")
        assert r.refers_to == (rows[1].record_id if page in (2, 9) else None)
        assert r.payload == (None if page in (2, 9) else data)
        assert r.target_uri == (url or "urn:none").replace(" ", "%20") and r.warc_date == "2024-01-01T00:00:00Z"
    assert len({r.record_id for r in rows.values()}) == len(rows)


def test_the_query_keeps_repeated_and_null_ids(spark, tmp_path):
    long = "<p>" + "long " * 40 + "</p>"
    pages = [(3, "http://a", long), (5, "http://b", "short"), (5, "http://b", "short"), (7, "http://c", long), (7, "http://c", long), (None, "http://d", long), (None, None, None), (2, "http://e", "end\r\n" + "y" * 120 + "\r\n")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op4_warc_archive(spark, str(tmp_path)).collect()
    want = Counter()
    seen = set()
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= 100 and data in seen
        seen.add(data)
        want[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert Counter(map(tuple, got)) == want


def test_empty_table(spark):
    work = Workspace(spark, "warctest")
    records = warc.convert_arc(archive(spark, PAGES).limit(0)).withColumn("order", F.lit(1))
    path = work.new_path("warc")
    warc.write_warc(records, warc.first_copies(records, "order", work), path)
    assert warc.read_warc(spark, path).count() == 0


def test_versions_and_plain_blocks():
    one = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain 75\n" + b"1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n"[:75].ljust(75) + b"\n"
    body = b"dns answer"
    data = one + b"dns:a b 1.2.3.4 2001020304 text/dns 10\n" + body + b"\n"
    found = list(warc.parse_arc(gzip.compress(data)))
    assert [f["url"] for f in found] == ["filedesc://x.arc", "dns:a b"] and found[1]["block"] == body
    record = warc.to_record("x.arc", found[1])
    assert (record["warc_type"], record["content_type"], record["warc_date"]) == ("resource", "text/dns", "2001-02-03T04:00:00Z")
    assert warc.to_record("x.arc", found[1])["record_id"] == record["record_id"]


@pytest.mark.parametrize("data", [b"no version block\n", b"filedesc://x 0 20010101000000 text/plain 900\n1 0 x\n", b"filedesc://x 0 20010101000000 text/plain 6\n9 0 x\n\n"])
def test_malformed_archives_raise(data):
    with pytest.raises(ValueError):
        list(warc.parse_arc(data))


DAMAGED = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nshort\r\n\r\n"


@pytest.mark.parametrize("size", [50, 3])
def test_a_damaged_warc_raises(size):
    with pytest.raises(ValueError):
        list(warc.parse_warc([DAMAGED % size]))


@pytest.mark.parametrize("step", [1, 7, 64, 10_000])
def test_records_are_the_same_in_any_chunks(step):
    blocks = [b"", b"a\r\n", b"\r\n\r\nWARC/1.1\r\n\r\n", b"x" * 300]
    data = b"".join(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    found = list(warc.parse_warc(data[i : i + step] for i in range(0, len(data), step)))
    assert [f["block"] for f in found] == blocks and all(data[f["offset"] :].startswith(b"WARC/") for f in found)


def test_plain_files_that_spark_splits(spark, tmp_path):
    """A plain archive many times as large as one split is read like its packed twin."""
    def record(n: int) -> bytes:
        body = (f"HTTP/1.1 200 OK\r\nX-Page-Id: {n}\r\n\r\n" + f"page {n} \r\n\r\n é " * (n % 40)).encode()
        digest = hashlib.sha256(body.partition(b"\r\n\r\n")[2]).hexdigest()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{n}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    for name in ("a.warc", "b.warc"):
        (tmp_path / name).write_bytes(b"".join(record(n) for n in range(300)))
    with gzip.open(tmp_path / "c.warc.gz", "wb") as f:
        f.write(b"".join(record(n) for n in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file[-9:], []).append((r.offset, r.record_id, r.payload_bytes, bytes(r.payload)))
    assert len(by_file) == 3 and len({tuple(sorted(v)) for v in by_file.values()}) == 1 and len(rows) == 900
