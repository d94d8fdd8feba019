"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.components import connected_components
from attestor.session import Workspace

BITS = 64
SEED = 42
#: Fingerprints of one bucket compared with each other at once; larger buckets are cut further.
BUCKET = 2048
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is 1 if set in over half of the shingles' hashes; 0 without words."""
    import xxhash

    tokens = text.encode().translate(_LOWER).split()  # bytes.split() cuts at 0x20 and 0x09-0x0D
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        hashes = np.fromiter((digest(b" ".join(tokens[i : i + words]), SEED) for i in range(a, b)), np.uint64, b - a)
        total += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fp", words: int = 3) -> DataFrame:
    """Add the SimHash of ``words``-word shingles as a long; null counts as the empty text, whose fingerprint is 0."""

    @F.arrow_udf(T.LongType())
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py() or "", words) for t in batch], pa.int64())

    return df.withColumn(out_col, simhash(F.col(text_col)))


def _variants(fps: DataFrame, width: int, halves: list, prefix: list[str]) -> DataFrame:
    """A row for each half of ``width`` bits and each of its bits left out; the key fixes the bits that remain."""
    both = F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("variant")
    out = fps.select("*", both)
    part = F.when(F.col("variant") < width, halves[0]).otherwise(halves[1])
    hole = F.expr(f"shiftleft(1L, cast(variant % {width} as int))")
    key = F.col("variant").cast("long") * F.lit(1 << width) + part.bitwiseAND(F.bitwise_not(hole))
    return out.select("fp", *prefix, key.alias(f"key{len(prefix)}"))


def _low(column, at: int, width: int):
    return F.shiftrightunsigned(column, at).bitwiseAND(F.lit((1 << width) - 1))


def _compare(fps: np.ndarray, limit: int, rule) -> np.ndarray:
    """Star links (node, local root) that join what is within ``limit`` bits inside one bucket."""
    n = len(fps)
    label = np.arange(n)
    step = max(1, (1 << 22) // n)
    lefts, rights = [], []
    for a in range(0, n, step):
        diff = fps[a : a + step, None] ^ fps[None, :]
        near = np.bitwise_count(diff) <= limit
        near &= np.arange(n)[None, :] > np.arange(a, min(n, a + step))[:, None]
        i, j = np.nonzero(near)
        if len(i):
            own = rule(diff[i, j])
            lefts.append(i[own] + a)
            rights.append(j[own])
    if not lefts:
        return np.zeros((0, 2), dtype=np.int64)
    left, right = np.concatenate(lefts), np.concatenate(rights)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([fps[moved].view(np.int64), fps[label[moved]].view(np.int64)], axis=1)


def _first_key(key: int):
    """Which differences a bucket of the first cut owns, so that a pair is compared in one bucket only."""
    variant = key >> 32
    segment, hole = divmod(variant, 32)

    def owns(diff: np.ndarray) -> np.ndarray:
        low, high = diff & np.uint64(0xFFFFFFFF), diff >> np.uint64(32)
        own = low if segment == 0 else high
        here = own == np.uint64(1 << hole)
        if hole == 0:
            here |= own == 0
        return here if segment == 0 else here & (np.bitwise_count(low) > 1)

    return owns


def _links(pairs: DataFrame, keys: list[str], limit: int, bucket: int | None) -> DataFrame:
    """Links inside every bucket of rows (fp, *keys); rows of buckets above ``bucket`` come back as (fp, null, keys)."""
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("root", T.LongType()), *[T.StructField(k, T.LongType()) for k in keys]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(table: np.ndarray):
            fps = np.unique(table[:, 0])
            if bucket is None or len(fps) <= bucket:
                found = _compare(fps.view(np.uint64), limit, _first_key(int(table[0, 1])))
                return np.concatenate([found, np.zeros((len(found), len(keys)), np.int64)], axis=1), True
            return table, False

        def emit(rows: np.ndarray, linked: bool):
            if not linked:
                rows = np.concatenate([rows[:, :1], rows[:, :1], rows[:, 1:]], axis=1)
            root = pa.array(rows[:, 1], pa.int64(), mask=None if linked else np.ones(len(rows), bool))
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), root, *[pa.array(rows[:, 2 + i]) for i in range(len(keys))]], schema=pa.schema([("fp", pa.int64()), ("root", pa.int64()), *[(k, pa.int64()) for k in keys]]))

        held, over = np.zeros((0, 1 + len(keys)), np.int64), None
        for batch in batches:
            new = np.stack([np.asarray(c) for c in batch.columns], axis=1).astype(np.int64)
            if not len(new):
                continue
            if over is not None:  # rows of a bucket already known to be too large
                same = (new[:, 1:] == over).all(axis=1)
                n = len(new) if same.all() else int(np.argmin(same))
                if n:
                    yield emit(new[:n], False)
                if n == len(new):
                    continue
                new, over = new[n:], None
            rows = np.concatenate([held, new])
            cuts = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
            whole = (ends - starts > 1) & (ends < len(rows))
            links = []
            for a, b in zip(starts[whole], ends[whole], strict=True):
                part, linked = close(rows[a:b])
                if linked:
                    links.append(part)
                else:
                    yield emit(part, False)
            held = rows[starts[-1] :]
            if bucket is not None and len(held) > 2 * bucket and len(np.unique(held[:, 0])) > bucket:
                yield emit(held, False)
                over, held = held[0, 1:], held[:0]
            if links and len(found := np.unique(np.concatenate(links), axis=0)):
                yield emit(found, True)
        if len(held) > 1:
            part, linked = close(held)
            if len(part):
                yield emit(part, linked)

    return pairs.select("fp", *keys).repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, schema)


def link_fingerprints(fps: DataFrame, work: Workspace, limit: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (fp, root) that connect exactly the distinct fingerprints within ``limit`` = 3 bits of each other.

    A fingerprint is cut into two segments of 32 bits: of two that differ in at most three bits one
    segment differs in at most one. Each is indexed under its 64 segment variants with one bit left out,
    and what shares a variant is compared. A bucket of over ``bucket`` fingerprints is cut again by the
    other segment (two of 16 bits, one of which differs in at most one bit) and then by the half left
    over (two of 8 bits), which leaves at most 2,048 possible values; so no bucket grows without bound
    and no pair is lost. Within a bucket links form stars, never all pairs.
    """
    if limit != 3:
        raise ValueError("the segment widths are made for 3 bits")
    cut = work.save(_links(_variants(fps, 32, [_low(F.col("fp"), 0, 32), _low(F.col("fp"), 32, 32)], []), ["key0"], limit, bucket), "cut0")
    links = [cut.where("root is not null").select("fp", "root")]
    hot = cut.where("root is null").select("fp", "key0")
    if not hot.isEmpty():
        other = F.when(F.col("key0") < F.lit(32 << 32), _low(F.col("fp"), 32, 32)).otherwise(_low(F.col("fp"), 0, 32))
        cut = work.save(_links(_variants(hot, 16, [_low(other, 0, 16), _low(other, 16, 16)], ["key0"]), ["key0", "key1"], limit, bucket), "cut1")
        links.append(cut.where("root is not null").select("fp", "root"))
        hot = cut.where("root is null").select("fp", "key0", "key1")
        if not hot.isEmpty():
            rest = F.when(F.col("key1") < F.lit(16 << 16), _low(other, 16, 16)).otherwise(_low(other, 0, 16))
            cut = work.save(_links(_variants(hot, 8, [_low(rest, 0, 8), _low(rest, 8, 8)], ["key0", "key1"]), ["key0", "key1", "key2"], limit, None), "cut2")
            links.append(cut.where("root is not null").select("fp", "root"))
    out = links[0]
    for more in links[1:]:
        out = out.unionAll(more)
    return out


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(id, fingerprint, component_id) of every row: rows link where fingerprints differ in at most 3 of 64 bits.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id reachable. Null and empty
    texts have fingerprint 0 and link like any other; a row without id is kept and takes the component
    of its fingerprint (null if no member has an id); repeated rows stay repeated; other columns are not
    read; an empty table gives an empty table. Copies meet in a pre-aggregated count of fingerprints, so
    only distinct fingerprints are indexed.
    """
    spark = df.sparkSession
    work = Workspace(spark, "simhash")
    marked = work.save(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "body", "fp", words).select("id", "fp"), "fingerprints")
    distinct = work.save(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    roots = connected_components(link_fingerprints(distinct.select("fp"), work, bucket=bucket), "fp", "root", work)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = work.save(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")  # written, so that the join can split a hot root
    label = work.save(rooted.join(least, "root").select(F.col("fp").alias("key"), "component_id"), "labels")
    return marked.join(label, marked.fp == label.key, "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
