"""Byte-level BPE encoding by a rank queue on a hierarchical bitmap, and decoding."""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice, pairwise

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestor.llm.tokenizer_io import by_bytes

BATCH_BYTES = 1 << 20
#: Pre-tokens encoded at once of a long text.
STEP = 1 << 16
#: Pre-tokens of at most so many characters are remembered, and so many of them.
REMEMBERED_CHARS, REMEMBERED = 48, 1 << 20


class _Known(dict):
    """Packed ids by pre-token; what is asked for first is encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        packed = self.encode(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed


class ByteBpe:
    """A byte-level vocabulary with its merges.

    ``ranks`` has the merge rank of each token of two or more bytes, ``ids`` the id of each token. ``cut`` is None where any
    two neighbours may merge that make a token, else it has by rank the bytes of the left part that alone may.
    With ``whole`` a pre-token that is a token is never merged from its bytes.
    """

    def __init__(self, ids: dict[bytes, int], ranks: dict[bytes, int], cut: list[int] | None, whole: bool, pattern: str):
        self.ids, self.ranks, self.cut, self.whole = ids, ranks, cut, whole
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ids.values(), default=-1) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token
        #: Ranks of two single bytes, by the number that they make.
        self.of_two = [ranks.get(bytes(divmod(x, 256)), -1) for x in range(1 << 16)]
        #: The rank queue, empty between two pre-tokens: 256 ranks a word, and positions by rank.
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}
        self._known = _Known(self._packed)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, by a queue of pairs in which the lowest rank comes first, and of these the leftmost place.

        Tokens are a linked list of byte positions. Each rank has a bucket of positions at which such a pair begins (a heap, so
        that the leftmost comes first). Two levels of words of 256 bits say which buckets hold any: the lowest is
        found by two searches for a first set bit, whatever the number of ranks and pairs. A pair that was queued and is no
        more, as one of its tokens has since merged with another, is known by the rank noted at its place and skipped.
        """
        n, get, cut, words, buckets = len(piece), self.ranks.get, self.cut, self.words, self.buckets
        of_two = self.of_two
        pair = [of_two[x << 8 | y] for x, y in pairwise(piece)]
        pair.append(-1)
        after, before, top, i = list(range(1, n + 1)), list(range(-1, n - 1)), 0, 0
        for rank in pair:
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
            i += 1
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[j] = pair[i] = -1
            h = before[i]
            if k < n:
                before[k] = i
                if (rank := get(piece[i : after[k]])) is not None and (cut is None or cut[rank] == k - i):
                    pair[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        words[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
            if h >= 0:
                pair[h] = -1
                if (rank := get(piece[h:k])) is not None and (cut is None or cut[rank] == i - h):
                    pair[h] = rank
                    if rank in buckets:
                        heappush(buckets[rank], h)
                    else:
                        buckets[rank] = [h]
                        words[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
        out, i, ids = [], 0, self.ids
        while i < n:
            out.append(ids[piece[i : after[i]]])
            i = after[i]
        return out

    def _packed(self, word: str) -> bytes:
        piece = word.encode()
        known = self.ids.get(piece) if self.whole else None
        return array("I", self.merge(piece) if known is None else (known,)).tobytes()

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, STEP pre-tokens at a time."""
        if len(text) <= 4 * STEP:
            parts = iter([self.pattern.findall(text)])
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            parts = iter(lambda: list(islice(found, STEP)), [])
        for words in parts:
            yield b"".join(map(self._known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: bytes that print stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The vocabulary of a .tiktoken or byte-level .json file, kept by each Python worker."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return ByteBpe(ids, {t: r for t, r in ids.items() if len(t) > 1}, None, True, pattern)
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre, model = made.get("pre_tokenizer") or {}, made["model"]
    if made.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"{path} is no plain byte-level BPE")
    of = _byte_of_char()
    raw = lambda t: bytes(map(of.__getitem__, t))
    merges = [(raw(a), raw(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    ranks = {a + b: r for r, (a, b) in enumerate(merges)}
    if len(ranks) < len(merges):
        raise ValueError(f"{path} makes a token by two merges")
    return ByteBpe({raw(t): i for t, i in model["vocab"].items()}, ranks, [len(a) for a, _ in merges], False, pattern)


def _append(df: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, column: str, make, batch_bytes: int) -> DataFrame:
    """``df`` with a column made of another, at most ``batch_bytes`` of it or one row at a time."""
    df = df.drop(name)
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(names.index(column))
            sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
            for a, b in by_bytes(sizes, batch_bytes):
                made = pa.array([make(v.as_py()) for v in values.slice(a, b - a)], arrow)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], made], names=[*names, name])

    return df.mapInArrow(run, schema)


def encode_bytes(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Add ``out_col`` (binary): the ids of each whole text as little-endian unsigned 32-bit integers.

    ``path`` is a .tiktoken or byte-level .json vocabulary that every executor can read. Each match of ``pattern`` is encoded
    on its own, without special tokens: the pair of lowest rank, and of these the leftmost, merges until none is left, found by a
    rank queue, so that a pre-token of n bytes takes n log n steps at most. Null and empty texts have no ids; rows, ties,
    repeats and other columns stay; a column named ``out_col`` is replaced; an empty table stays empty. No shuffle.
    """

    def make(text: str | None) -> bytes:
        return b"".join(byte_bpe(path, pattern).encode(text or ""))

    return _append(df, out_col, T.BinaryType(), pa.binary(), text_col, make, batch_bytes)


def decode_bytes(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Add ``out_col`` (binary): the bytes that the ids in ``ids_col`` stand for; null has none. An id beyond the vocabulary is an error.

    Rows, repeats and other columns stay, a column named ``out_col`` is replaced.
    """

    def make(ids: bytes | None) -> bytes:
        return byte_bpe(path, pattern).decode(ids or b"")

    return _append(df, out_col, T.BinaryType(), pa.binary(), ids_col, make, batch_bytes)
