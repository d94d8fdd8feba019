"""Ranked lexical search over a bit-sliced index of integer impacts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attestor.session import Workspace

#: Items searched, with their terms broadcast, at once, by bytes of their text.
PASS_BYTES = 4 << 20
#: Documents and postings of one block of the index, at most (or one document's postings).
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 13, 1 << 19
#: Bytes of a text split into terms at once.
STEP = 1 << 22
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_SLICE = np.dtype("<u8")


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, up to STEP bytes of it at a time: runs of ASCII letters, digits and all that is not ASCII; only A to Z are lower-cased."""
    raw = (text or "").encode().translate(_PLAIN)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + STEP) if len(raw) - start > STEP else -1
        yield raw[start : end if end >= 0 else len(raw)].split()
        start = end if end >= 0 else len(raw)


def document_terms(df: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, term, tf) of every row: its number of terms, and number and count of those in ``vocabulary``."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                n, counts = 0, Counter()
                for part in terms(text.as_py()):
                    n += len(part)
                    counts.update(map(get, part))
                counts.pop(None, None)
                known = sorted(counts.items())
                for column, value in zip(rows, (doc.as_py(), n, [t for t, _ in known], [c for _, c in known]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(rows, kinds, strict=True)], names=[k for k, _ in kinds])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


@dataclass(frozen=True)
class Statistics:
    """What weighs terms and lengths: documents with terms, all their terms, and the weight of each term of the vocabulary."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A term's part of a document's score, in integers."""
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def slices(place: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 documents that hold a term, and for each bit of its impacts, least first, the bitmap over these words."""
    words, at = np.unique(place >> 6, return_inverse=True)
    bits = np.zeros((int(impact.max()).bit_length(), 64 * len(words)), np.uint8)
    bits[:, at * 64 + (place & 63)] = impact >> np.arange(len(bits))[:, None] & 1
    return words.astype("<u2"), np.packbits(bits, axis=1, bitorder="little").view(_SLICE)


_BLOCK = T.StructType([T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("n_bits", T.ArrayType(T.IntegerType())), T.StructField("n_words", T.ArrayType(T.IntegerType())), T.StructField("body", T.BinaryType())])
_BLOCK_ARROW = pa.schema([("docs", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("n_bits", pa.list_(pa.int32())), ("n_words", pa.list_(pa.int32())), ("body", pa.binary())])


def bit_sliced_blocks(rows: DataFrame, statistics: Statistics) -> DataFrame:
    """The index of ``rows`` of document_terms(): per row a block of documents, and per term of it the bitmaps of the bits of its impacts.

    A block holds the next documents of a partition in order of doc_id (null last), at most BLOCK_DOCS of them with
    BLOCK_POSTINGS postings, or one; so it is built where its documents are and nothing is shuffled. Every document with an impact
    above 0 is in the index.
    """
    shared = rows.sparkSession.sparkContext.broadcast(statistics)

    def block_of(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: (r[0] is None, r[0] or 0))
        size = np.array([len(r[2]) for r in held])
        place = np.repeat(np.arange(len(held)), size)
        term = np.concatenate([r[2] for r in held])
        impact = shared.value.impacts(term, np.concatenate([r[3] for r in held]), np.repeat([r[1] for r in held], size))
        order = np.flatnonzero(impact > 0)
        order = order[np.argsort(term[order], kind="stable")]
        place, term, impact = place[order], term[order], impact[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        made = [slices(place[a:b], impact[a:b]) for a, b in zip(first, [*first[1:], len(term)], strict=True)]
        body = b"".join([w.tobytes() for w, _ in made] + [s.tobytes() for _, s in made])
        row = [[r[0] for r in held]], [term[first].tolist()], [[len(s) for _, s in made]], [[len(w) for w, _ in made]], [zstandard.compress(body, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, _BLOCK_ARROW.types, strict=True)], schema=_BLOCK_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = [], 0
        for batch in batches:
            for doc, n, term, tf in zip(*batch.columns, strict=True):
                term, tf = (np.asarray(x.values, np.int64) for x in (term, tf))
                if len(term):
                    if held and (len(held) == BLOCK_DOCS or postings + len(term) > BLOCK_POSTINGS):
                        yield block_of(held)
                        held, postings = [], 0
                    held.append((doc.as_py(), n.as_py(), term, tf))
                    postings += len(term)
        if held:
            yield block_of(held)

    return rows.select("doc_id", "n", "term", "tf").mapInArrow(run, _BLOCK)


class Block:
    """One block of the index in memory."""

    def __init__(self, docs: list[int | None], terms: list[int], n_bits: list[int], n_words: list[int], body: bytes):
        self.docs, self.width = docs, (len(docs) + 63) // 64
        raw = zstandard.decompress(body)
        word_at, slice_at = 0, 2 * sum(n_words)
        self.terms: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for term, bits, words in zip(terms, n_bits, n_words, strict=True):
            self.terms[term] = np.frombuffer(raw, "<u2", words, word_at), np.frombuffer(raw, _SLICE, bits * words, slice_at).reshape(bits, words)
            word_at += 2 * words
            slice_at += 8 * bits * words

    def scores(self, wanted: list[int]) -> np.ndarray | None:
        """Bitmaps of the bits of every document's sum over the terms, least first.

        Each term is added bit by bit to all documents at once, its carries kept apart from the sums until the end, where one
        ripple of carries adds the two.
        """
        found = [self.terms[t] for t in wanted if t in self.terms]
        if not found:
            return None
        height = max(len(s) for _, s in found) + len(found).bit_length()
        total, carry = np.zeros((height, self.width), _SLICE), np.zeros((height, self.width), _SLICE)
        for words, rows in found:
            at = slice(None) if len(words) == self.width else words
            a, b = total[:, at], carry[:, at]
            add = np.zeros_like(a)
            add[: len(rows)] = rows
            one = a ^ b
            two = a & b | one & add
            total[:, at] = one ^ add
            carry[0, at] = 0
            carry[1:, at] = two[:-1]
        ripple = np.zeros(self.width, _SLICE)
        for i in range(height):
            one = total[i] ^ carry[i]
            total[i], ripple = one ^ ripple, total[i] & carry[i] | one & ripple
        return total

    def top(self, wanted: list[int], k: int) -> tuple[list[int | None], list[int]]:
        """The ``k`` documents of highest score above 0, of equal scores those of smallest id, with their scores.

        From the most significant slice down: the documents that are surely among the k, and those still level with the
        last of them. A slice splits the level ones: where its ones fit they are sure, else they alone stay level.
        """
        total = self.scores(wanted)
        if total is None:
            return [], []
        level, sure = np.bitwise_or.reduce(total, axis=0), np.zeros(self.width, _SLICE)
        count = lambda bits: int(np.bitwise_count(bits).sum())
        n_sure = 0
        if count(level) <= k:
            sure = level
        else:
            for row in total[::-1]:
                ones = level & row
                n = n_sure + count(ones)
                if n > k:
                    level = ones
                else:
                    sure, level, n_sure = sure | ones, level & ~row, n
            rest = np.flatnonzero(np.unpackbits(level.view(np.uint8), bitorder="little"))[: k - n_sure]
            np.bitwise_or.at(sure, rest >> 6, np.uint64(1) << (rest & 63).astype(np.uint64))
        place = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        bits = (total[:, place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        return [self.docs[p] for p in place], (bits << np.arange(len(bits))[:, None]).sum(axis=0).tolist()


def search(blocks: DataFrame, items: list[tuple[int | None, list[int]]], k: int) -> DataFrame:
    """(item, item_id, doc_id, score): for every item and partition of ``blocks`` its ``k`` best documents; ``item`` is the place in ``items``."""
    shared = blocks.sparkSession.sparkContext.broadcast(items)
    arrow = pa.schema([(n, pa.int64()) for n in ("item", "item_id", "doc_id", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(*(c[i].as_py() for c in batch.columns))
                for item, (_, wanted) in enumerate(shared.value):
                    docs, scores = block.top(wanted, k)
                    if docs:
                        rows = best[item] + [(-s, d is None, d or 0) for d, s in zip(docs, scores, strict=True)]
                        best[item] = sorted(rows)[:k]
        out = [(item, shared.value[item][0], None if none else d, -s) for item, rows in enumerate(best) for s, none, d in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=arrow)

    return blocks.select("docs", "terms", "n_bits", "n_words", "body").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def rank_documents(df: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the ``k`` documents of highest score above 0.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, of whole texts. A document's score adds up, over the
    different terms of the item, the term's weight times a part that grows with its count and falls with the document's length, all in
    integers; equal scores go by ascending doc_id (null last). Lengths, document frequencies and totals are those of all
    documents.

    Per pass of about ``pass_bytes`` of items, whose terms are broadcast: documents become counts of these terms (written once), these
    become the bit-sliced index (written), and every partition of the index gives its ``k`` best of each item, of which the
    best of all stay. Texts are not shuffled. An index block is searched for all items of the pass.

    A null text has no terms, as an empty one; such documents and those without any term of an item are not ranked for it.
    Each row of ``items`` is an item, repeats and null ids included; one without terms gets no rows. Repeated rows and ids of
    ``df`` are documents of their own. An empty table on either side gives no rows.
    """
    spark, work = df.sparkSession, Workspace(df.sparkSession, "impacts")
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("body")).where("body is not null")
    size = asked.agg(F.sum(F.octet_length("body"))).first()[0]
    passes = max(1, -(-(size or 0) // pass_bytes))
    found = None
    for p in range(passes):
        wanted, vocabulary = [], {}
        some = asked.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(passes)) == p)
        for item, body in some.orderBy("item_id", "body").collect():
            own = dict.fromkeys(t for part in terms(body) for t in part)
            wanted.append((item, [vocabulary.setdefault(t, len(vocabulary)) for t in own]))
        rows = work.save(document_terms(df, vocabulary, id_col, text_col), "terms")
        n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = rows.select(F.explode("term").alias("term")).groupBy("term").count()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, n in frequency.collect():  # as many as the vocabulary of one pass
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        blocks = work.save(bit_sliced_blocks(rows, Statistics(n_docs, n_terms, weights)), "index")
        part = search(blocks, wanted, k).withColumn("part", F.lit(p))
        found = part if found is None else found.unionAll(part)
    best = Window.partitionBy("part", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
