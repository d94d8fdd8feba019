"""Removal of every byte that a string of 200 bytes repeated anywhere covers."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.anchors import SIDE, WINDOW, anchors
from attestor.llm.interleave import repeated_windows
from attestor.session import Workspace

#: Different contexts of one anchor that are merged in one task; those of a more frequent anchor are counted window by window.
GROUP = 1 << 15
#: Contexts merged at once, and the shards they come from.
BATCH, SHARDS = 1 << 12, 4
EMPTY = hashlib.sha256(b"").hexdigest()
_CTX = "hash long, cid binary, pos int, weight long, n_left int, bytes binary"


def _ints(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(kind) if values else np.zeros(0, kind)))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            texts = [(t.as_py() or "").encode() for t in batch.column("body").slice(a, 1000)]
            found = [anchors(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(a, 1000), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
                    _ints([f[0] for f in found], np.int32), _ints([f[1] for f in found], np.int64), _ints([f[2] for f in found], np.int64),
                ],
                names=["id", "sha", "n_bytes", "pos", "hash", "ctx"],
            )


def _wanted_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, dict, int, bytes]]:
    """Each wanted anchor of each text with the bytes beside it: up to SIDE to the left, the anchor, up to SIDE to the right."""
    for batch in batches:
        for cid, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            for w in wanted:
                first = max(0, w["pos"] - SIDE)
                yield cid, w, w["pos"] - first, data[first : w["pos"] + WINDOW]


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in batched(_wanted_contexts(batches), 10_000):
        rows = [(w["hash"], cid, w["pos"], w["c"], n_left, raw) for cid, w, n_left, raw in some]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["hash", "cid", "pos", "weight", "n_left", "bytes"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a context, with its anchor and place, by a digest of 128 bits, for anchors of too many contexts; those of copies have no cid."""
    for some in batched(_wanted_contexts(batches), 64):
        cids, starts, digests = [], [], []
        for cid, w, n_left, raw in some:
            for at in range(max(0, n_left - SIDE), min(n_left, len(raw) - WINDOW) + 1):
                cids.append(cid if w["c"] == 1 else None)
                starts.append(w["pos"] - n_left + at)
                digests.append(xxhash.xxh3_128_digest(raw[at : at + WINDOW] + (n_left - at).to_bytes(2, "big") + w["hash"].to_bytes(8, "big", signed=True)))
        yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(starts, pa.int32()), pa.array(digests, pa.binary())], names=["cid", "pos", "window"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of anchor to (cid, pos, mask of the window starts that repeat), about BATCH at a time."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        column = lambda k: table.column(k).combine_chunks()
        cids = column("cid").to_pylist()
        shard = np.array([c[-1] % SHARDS for c in cids])
        masks = repeated_windows(column("bytes").to_pylist(), np.asarray(column("n_left")), shard, WINDOW, SIDE)
        alone = np.flatnonzero((np.asarray(column("weight")) == 1) & masks.any(axis=1))
        packed = [m.tobytes() for m in np.packbits(masks[alone], axis=1, bitorder="little")]
        return pa.RecordBatch.from_arrays([pa.array([cids[i] for i in alone], pa.binary()), pa.array(np.asarray(column("pos"))[alone], pa.int32()), pa.array(packed, pa.binary())], names=["cid", "pos", "mask"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            held.append(batch.slice(a, BATCH))
            size += held[-1].num_rows
            if size < BATCH:
                continue
            table = pa.Table.from_batches(held)
            every = np.asarray(table.column("hash").combine_chunks())
            cut = int(np.argmax(every == every[-1]))
            if cut:
                yield solve(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), len(every) - cut
    if size:
        yield solve(pa.Table.from_batches(held))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text once the flagged windows are cut out."""
    for batch in batches:
        out = []
        for cid, text, flags in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            edge = np.zeros(len(data) + 1, np.int32)
            starts = [np.zeros(0, np.int64)]
            for flag in flags:
                p = flag["pos"]
                if flag["mask"] is None:
                    starts.append(np.arange(max(0, p - SIDE), min(p, len(data) - WINDOW) + 1) if flag["whole"] else np.array([p]))
                else:
                    starts.append(p - np.flatnonzero(np.unpackbits(np.frombuffer(flag["mask"], np.uint8), bitorder="little")[: SIDE + 1]))
            begin = np.unique(np.concatenate(starts))
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
            out.append((cid, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cid", "n_removed", "n_spans", "kept_sha256"])


def _release(spark) -> None:
    """Let Spark drop the shuffle files of tables that are already written; without it nothing but the use of disk changes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): every byte under a 200-byte string that starts twice is removed.

    Strings are compared as UTF-8 bytes, within documents and across them, on the input; a match never crosses documents.
    Every window of 200 bytes has an anchor of 64 bytes chosen by content, so equal windows meet at equal anchors,
    about one for 69 bytes. Anchors that occur once are dropped by a pre-aggregated count. For the others the
    context, the anchor with 136 bytes on either side, goes to the task of its anchor. There the contexts of each of
    SHARDS shards of the corpus become a Burrows-Wheeler transform, and the transforms are merged by refining their
    interleave; its intervals of suffixes with 200 bytes in common are the repeats. Copies of a context are
    counted, not merged, and texts that occur more than once are removed whole. An anchor with over ``group``
    different contexts never meets in one task: its windows are counted by digest, in a pre-aggregated count.

    Null texts count as empty; texts under 200 bytes lose nothing, however often they occur; rows that repeat stay
    repeated; other columns are ignored; an empty table gives an empty table.
    """
    spark = df.sparkSession
    work = Workspace(spark, "repeats")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha_of = lambda body: F.unhex(F.sha2(body, 256))
    cid = F.substring(F.col("sha"), 1, 16)  # 128 bits

    rows = df.select(F.col(id_col).alias("id"), text.alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_anchor_rows, f"id {kind}, sha binary, n_bytes long, pos array<int>, hash array<long>, ctx array<long>")
    same = found.groupBy("sha").agg(F.count("*").alias("n"), F.min("id").alias("one"), F.first("n_bytes").alias("n_bytes"), F.first(F.struct("pos", "hash", "ctx")).alias("a"))
    texts = work.save(same.select(cid.alias("cid"), "sha", "n", "one", "n_bytes", "a.*"), "texts")
    _release(spark)

    each = F.explode(F.arrays_zip("pos", "hash", "ctx")).alias("x")
    places = texts.select("cid", "n", each).select("cid", "n", "x.pos", "x.hash", "x.ctx")
    often = work.save(places.groupBy(F.col("hash").alias("h")).agg(F.sum("n").alias("s")).where("s > 1").select("h"), "often")  # written, so that the join can split a hot anchor
    shared = work.save(places.join(often, places.hash == often.h).select("cid", "n", "pos", "hash", "ctx"), "shared")
    _release(spark)

    kinds = work.save(shared.groupBy("hash", "ctx").agg(F.sum("n").alias("c"), F.min(F.struct("cid", "pos")).alias("who")), "contexts")
    mixed = kinds.groupBy(F.col("hash").alias("h")).agg(F.count("*").alias("u"), F.min("c").alias("least")).where("u > 1 and least = 1").select("h", (F.col("u") > group).alias("hot"))
    mixed = work.save(mixed, "mixed")
    wanted = kinds.join(mixed, kinds.hash == mixed.h).select("who.cid", F.struct("who.pos", "hash", "c", "hot").alias("w"))
    wanted = wanted.groupBy("cid").agg(F.collect_list("w").alias("wanted"))
    lone = shared.where("n = 1").select("cid").distinct()
    none = F.array().cast("array<struct<pos:int,hash:long,c:long,hot:boolean>>")
    asked = lone.join(wanted, "cid", "full_outer").join(texts.select("cid", "one"), "cid").select(F.col("cid").alias("key"), "one", F.coalesce("wanted", none).alias("wanted"))
    whole = rows.withColumn("sha", sha_of(F.col("body"))).select("id", cid.alias("cid"), "body")
    chosen = work.save(whole.join(asked, (F.col("cid") == F.col("key")) & F.col("id").eqNullSafe(F.col("one"))).select("cid", "body", "wanted"), "bodies")  # one row of each text
    _release(spark)

    some = lambda hot: chosen.select("cid", "body", F.filter("wanted", lambda w: w.hot if hot else ~w.hot).alias("wanted")).where(F.size("wanted") > 0)
    contexts = some(False).mapInArrow(_context_rows, _CTX)
    solved = work.save(contexts.repartition("hash").sortWithinPartitions("hash").mapInArrow(_merge, "cid binary, pos int, mask binary"), "solved")
    windows = work.save(some(True).mapInArrow(_window_rows, "cid binary, pos int, window binary"), "windows")
    _release(spark)

    twice = windows.groupBy(F.col("window").alias("w")).agg(F.count("*").alias("c"), F.count_if(F.col("cid").isNull()).alias("many")).where("c > 1 or many > 0").select("w")
    by_window = windows.where("cid is not null").join(twice, F.col("window") == F.col("w")).select("cid", "pos", F.lit(None).cast("binary").alias("mask"), F.lit(False).alias("whole"))
    by_mask = solved.select("cid", "pos", "mask", F.lit(False).alias("whole"))
    copies = kinds.where("c > 1").select(F.col("hash").alias("h"), F.col("ctx").alias("x"))
    by_copy = shared.where("n = 1").join(copies, (F.col("hash") == F.col("h")) & (F.col("ctx") == F.col("x"))).select("cid", "pos", F.lit(None).cast("binary").alias("mask"), F.lit(True).alias("whole"))
    flags = by_mask.unionAll(by_window).unionAll(by_copy).groupBy(F.col("cid").alias("key")).agg(F.collect_list(F.struct("pos", "mask", "whole")).alias("flags"))
    cut = work.save(chosen.select("cid", "body").join(flags, F.col("cid") == F.col("key")).select("cid", "body", "flags").mapInArrow(_keep, "cid binary, n_removed long, n_spans long, kept_sha256 string"), "cut")
    _release(spark)

    verdict = texts.join(cut.dropDuplicates(["cid"]), "cid", "left").select(F.col("sha").alias("key"), "n", F.col("n_bytes").alias("size"), "n_removed", "n_spans", "kept_sha256")
    sized = rows.select(F.col("id").alias(id_col), F.octet_length("body").cast("long").alias("n_bytes"), sha_of(F.col("body")).alias("sha"))
    met = sized.join(verdict, F.col("sha") == F.col("key"), "left")
    gone = (F.col("n") > 1) & (F.col("size") >= WINDOW)
    return met.select(
        id_col,
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
