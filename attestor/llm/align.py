"""Alignment of two tokenizers' tokens over the same bytes, by a sweep over the places where tokens end."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.byte_bpe import REMEMBERED_CHARS, byte_bpe
from attestor.llm.tokenizer_io import MARK, by_bytes, model_proto, sentencepiece_model, split_text, splits_at_spaces
from attestor.session import Workspace

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16
#: Tokens whose ends travel as one row of events.
BLOCK_TOKENS = 1 << 13
#: Rows put out at once by the sweep, by what they hold.
OUT_BYTES = 1 << 22
#: Different pairs of one document kept apart before they are counted together.
LOOSE_PAIRS = 1 << 20
#: Pairs of ids whose counts are broadcast at once; more take several passes over the links.
BROADCAST_PAIRS = 1 << 20
#: Words whose pieces each Python worker remembers, and how many are encoded at once.
REMEMBERED_WORDS, WORDS_AT_ONCE = 1 << 19, 1 << 13
#: What stands behind one space: a word with the further spaces before it, and those that end the text.
_WORD = re.compile(r" ( *[^ ]+(?: +\Z)?| +\Z)")


@lru_cache(maxsize=4)
def _piece_bytes(path: str) -> tuple[list[bytes], np.ndarray, int]:
    """Bytes of each piece, their numbers, and the id of the unknown piece."""
    proto = model_proto(path)
    out = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
    return out, np.array([len(b) for b in out], np.int64), proto.trainer_spec.unk_id


@lru_cache(maxsize=4)
def _byte_widths(path: str, pattern: str) -> np.ndarray:
    return np.array([len(b) for b in byte_bpe(path, pattern).bytes_of], np.int64)


@lru_cache(maxsize=4)
def _piece_words(path: str) -> tuple[dict[str, bytes], np.ndarray] | None:
    """Packed ids of words met before, and by id whether the piece begins with the mark; None where words are not proven to stand alone.

    No piece holds a mark behind another character, so merges of pairs never cross the place before a run of spaces; as unknown
    characters become bytes, no two unknown pieces are joined there either.
    """
    proto = model_proto(path)
    spec = proto.trainer_spec
    if not (splits_at_spaces(path) and spec.model_type == spec.BPE and spec.byte_fallback):
        return None
    return {}, np.array([p.piece.startswith(MARK) for p in proto.pieces])


def _piece_ids(text: str, path: str) -> np.ndarray:
    """Ids of the pieces of a text as the library gives them; words that come again are not encoded again.

    New words go to the library in one text: those without spaces of their own begin at the pieces that begin with the mark.
    """
    model, made = sentencepiece_model(path), _piece_words(path)
    if made is None or MARK in text:
        return np.array([i for part in split_text(text, path, PIECE_CHARS) for i in model.encode(part)], np.uint32)
    known, begins = made
    words = _WORD.findall(" " + text) if "  " in text or text[0] == " " or text[-1] == " " else text.split(" ")
    new = set(words).difference(known)
    spaced = {w for w in new if " " in w}
    known.update((w, np.array(model.encode(w), "<u4").tobytes()) for w in spaced)
    single = list(new - spaced)
    for s in range(0, len(single), WORDS_AT_ONCE):
        some = single[s : s + WORDS_AT_ONCE]
        ids = np.array(model.encode(" ".join(some)), "<u4")
        raw, at = ids.tobytes(), [*(4 * np.flatnonzero(begins[ids])).tolist(), 4 * len(ids)]
        known.update(zip(some, (raw[x:y] for x, y in pairwise(at)), strict=True))
    out = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")
    for w in new:
        if len(w) > REMEMBERED_CHARS:
            del known[w]
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    return out


def both_tokens(text: str, byte_path: str, pattern: str, piece_path: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None:
    """Ids and widths in bytes of the tokens of a space and the text (A) and of the text (B); None where either's bytes are not those."""
    if not text:
        return None
    whole = b" " + text.encode()
    a = np.frombuffer(b"".join(byte_bpe(byte_path, pattern).encode(" " + text)), "<u4")
    widths_a = _byte_widths(byte_path, pattern)[a]
    of, widths, unknown = _piece_bytes(piece_path)
    b = _piece_ids(text, piece_path)
    widths_b = widths[b]
    if widths_a.sum() != len(whole) or widths_b.sum() != len(whole):  # byte-level tokens are the text's own bytes, if none is left out
        return None
    kept = splits_at_spaces(piece_path) and MARK not in text and not (b == unknown).any()  # nothing is normalised: pieces are the text's own bytes too
    return ((a, widths_a), (b, widths_b)) if kept or b"".join(map(of.__getitem__, b.tolist())) == whole else None


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _pack(ids: np.ndarray, widths: np.ndarray) -> bytes:
    """Ids and widths in the least bytes that hold the largest."""
    kind = lambda x: next(t for t in ("<u1", "<u2", "<u4") if x.max(initial=0) <= np.iinfo(t).max)
    i, w = kind(ids), kind(widths)
    return bytes([int(i[2]), int(w[2])]) + _compressor().compress(ids.astype(i).tobytes() + widths.astype(w).tobytes())


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    i, w = body[0], body[1]
    raw = _decompressor().decompress(body[2:])
    n = len(raw) // (i + w)
    return np.frombuffer(raw, f"<u{i}", n).astype(np.int64), np.frombuffer(raw, f"<u{w}", n, n * i).astype(np.int64)


def token_events(df: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(key, doc_id, side, at, body): where the tokens of both tokenizers end, as rows of up to BLOCK_TOKENS ends.

    ``key`` numbers the row of ``df``, ``side`` is 0 for A and 1 for B, ``at`` the byte at which the block's first token begins, and
    ``body`` has ids and widths. A row without tokens (null, empty, or bytes that do not agree) gives one empty block.
    """
    rows = df.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    schema = "key long, doc_id long, side int, at long, body binary"
    arrow = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("side", pa.int32()), ("at", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for x, y in by_bytes(sizes, batch_bytes):
                out: list[tuple] = []
                for key, doc, text in zip(*(c.slice(x, y - x).to_pylist() for c in batch.columns), strict=True):
                    sides = both_tokens(text, byte_path, pattern, piece_path)
                    if sides is None:
                        out.append((key, doc, 0, 0, None))
                        continue
                    for side, (ids, widths) in enumerate(sides):
                        ends = np.cumsum(widths)
                        for s in range(0, len(ids), BLOCK_TOKENS):
                            out.append((key, doc, side, int(ends[s - 1]) if s else 0, _pack(ids[s : s + BLOCK_TOKENS], widths[s : s + BLOCK_TOKENS])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _written(limit: int) -> np.ndarray:
    """Each id below ``limit`` in decimal behind a separator, by three times the id plus the separator's place in ``,;|``."""
    return np.array([f"{mark}{i}".encode() for i in range(limit) for mark in ",;|"])


def _changes(group: np.ndarray) -> np.ndarray:
    """1 for the first token of each group, else 0."""
    out = np.ones(len(group), np.int64)
    out[1:] = group[1:] != group[:-1]
    return out


class Sweep:
    """One document's ends in order: holds the tokens since the last place where both sides ended, and what is counted."""

    def __init__(self, key: int, doc: int | None):
        self.key, self.doc = key, doc
        self.ids = [np.zeros(0, np.int64)] * 2
        self.ends = [np.zeros(0, np.int64)] * 2
        self.closed = 0
        self.n_tokens, self.n_groups, self.n_links = [0, 0], 0, 0
        self.groups: list[str] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.loose = 0

    def feed(self, side: int, at: int, ids: np.ndarray, widths: np.ndarray) -> None:
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], at + np.cumsum(widths)])
        self.n_tokens[side] += len(ids)
        if len(self.ends[0]) and len(self.ends[1]):
            self.close()

    def close(self) -> None:
        """Put out the groups that are complete and the links inside them."""
        span = int(max(e[-1] for e in self.ends)) - self.closed + 1
        is_end = np.zeros((2, span), bool)
        ends = [e - self.closed for e in self.ends]
        for side in (0, 1):
            is_end[side, ends[side]] = True
        both = is_end[0] & is_end[1]
        common = np.concatenate(([0], np.flatnonzero(both)))  # by group, the byte behind which it begins
        if len(common) == 1:
            return
        ends_a, ends_b = np.cumsum(is_end[0]), np.cumsum(is_end[1])  # by byte, the tokens that have ended
        n, m = int(ends_a[common[-1]]), int(ends_b[common[-1]])
        a, b, end_a, end_b = self.ids[0][:n], self.ids[1][:m], ends[0][:n], ends[1][:m]

        first = ends_b[np.concatenate(([0], end_a[:-1]))]
        size = ends_b[end_a - 1] + 1 - first
        total = int(size.sum())
        met = np.arange(total) - np.repeat(np.cumsum(size) - size - first, size)
        self.n_links += total
        self.pairs.append(np.unique(np.repeat(a, size) << 32 | b[met], return_counts=True))
        self.loose += len(self.pairs[-1][0])
        if self.loose > LOOSE_PAIRS:
            self.pairs = [self.links()]
            self.loose = len(self.pairs[0][0])

        group = np.cumsum(both)
        group_a, group_b = group[end_a - 1], group[end_b - 1]
        codes = np.empty(n + m, np.int64)
        codes[np.arange(n) + ends_b[common[group_a]]] = a * 3 + _changes(group_a)
        codes[np.arange(m) + ends_a[common[group_b + 1]]] = b * 3 + 2 * _changes(group_b)
        table = _written(1 << int(codes.max() // 3).bit_length())
        self.groups.append(table[codes].tobytes().translate(None, b"\0").decode())
        self.n_groups += len(common) - 1
        self.ids = [self.ids[0][n:], self.ids[1][m:]]
        self.ends = [self.ends[0][n:], self.ends[1][m:]]
        self.closed += int(common[-1])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs of ids, packed, and how often each is linked."""
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.pairs) == 1:
            return self.pairs[0]
        keys, place = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in self.pairs])).astype(np.int64)

    def row(self) -> tuple:
        if len(self.ends[0]) or len(self.ends[1]):
            raise ValueError("the two sides do not cover the same bytes")
        keys, n = self.links()
        return self.key, self.doc, *self.n_tokens, self.n_groups, self.n_links, "".join(self.groups)[1:], keys >> 32, keys & 0xFFFFFFFF, n


_INTS = T.ArrayType(T.IntegerType())
_ALIGNED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("key", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups", T.StringType())] + [T.StructField(n, _INTS) for n in ("link_a", "link_b", "link_n")]
)


def align(events: DataFrame) -> DataFrame:
    """One row a document: numbers of tokens, groups and links, the groups written out, and the different links with their numbers.

    Documents are dealt out by key and their events sorted by where they begin; one pass over each partition holds, of one
    document at a time, the tokens since the last common end and the links counted so far. Bytes at which tokens of
    both sides end close a group; two tokens are linked where their bytes overlap. ``groups`` reads
    ``a1,a2|b1;a3|b2,b3``; ``link_a``, ``link_b`` and ``link_n`` are of equal length. Blocks may cut a group anywhere.
    """
    arrow = pa.schema([(n, pa.int64()) for n in ("key", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string())] + [(n, pa.list_(pa.int32())) for n in ("link_a", "link_b", "link_n")])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        lists = []
        for column in columns[7:]:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in column]))).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(column).astype(np.int32))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:7], arrow.types[:7], strict=True)] + lists, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now = [], 0, None
        for batch in batches:
            for key, doc, side, at, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        rows.append(now.row())
                        held += 100 + len(rows[-1][6]) + 12 * len(rows[-1][7])
                        if held > OUT_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                    now = Sweep(key, doc)
                if body is not None:
                    now.feed(side, at, *_unpack(body))
        if now is not None:
            yield batch_of([*rows, now.row()])

    dealt = events.repartition("key").sortWithinPartitions("key", "at", "side")
    return dealt.select("key", "doc_id", "side", "at", "body").mapInArrow(run, _ALIGNED)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): in how many documents each pair of ids is linked, and whether no pair of that ``a`` has more."""
    pairs = aligned.select(F.explode(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"))).alias("p")).select("p.a", "p.b")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n_docs"))
    most = counts.groupBy(F.col("a").alias("of")).agg(F.max("n_docs").alias("most"))
    return counts.join(most, counts.a == most.of).select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, work: Workspace, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` (written before) without its links, with ``n_best`` and ``count_sum``.

    ``count_sum`` adds up over a document's links the number of documents that hold the link's pair, ``n_best`` counts the links whose
    pair is held by most documents of all pairs of its A id. Counts are written once. At most ``broadcast_pairs`` of
    them (give or take what a hash leaves uneven) are broadcast at once: of more, each pass over the links takes those
    whose pair falls into its share, and the passes' sums are added by document.
    """
    counts = work.save(link_counts(aligned), "link_counts")
    passes = max(1, -(-counts.count() // broadcast_pairs))
    share = F.pmod(F.xxhash64("a", "b"), F.lit(passes))
    links = aligned.select("key", F.explode(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n"))).alias("l")).select("key", "l.a", "l.b", "l.n")
    sums = None
    for p in range(passes):
        some = links.where(share == p).join(F.broadcast(counts.where(share == p)), ["a", "b"])
        part = some.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
        sums = part if sums is None else sums.unionAll(part)
    if passes > 1:
        sums = sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rest = [c for c in aligned.columns if c not in ("link_a", "link_b", "link_n")]
    none = F.lit(0).cast("long")
    return aligned.select(*rest).join(sums, "key", "left").select(*rest, F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"))


def align_tokenizers(df: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum.

    A are the byte-level tokens of a space and the text, B the pieces of the text, whose mark stands for that space. Null
    and empty texts, and texts whose tokens do not give those bytes back (as with U+2581 in them), have zeros and ''. Rows
    that repeat, whole or by id, and null ids are documents of their own; very long texts travel in blocks; an empty
    table stays empty; other columns are not read.
    """
    work = Workspace(df.sparkSession, "align")
    made = align(token_events(df, byte_path, pattern, piece_path, id_col, text_col))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return score_links(work.save(made.withColumn("groups_sha256", digest).drop("groups"), "aligned"), work)
