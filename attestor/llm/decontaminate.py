"""Benchmark decontamination: every training passage against a BM25 index of test items."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.session import Workspace

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Share of an indexed part's own BM25 score that a passage must reach before its item is verified; less where that could lose an overlap.
THRESHOLD = 0.7
SHINGLE, OVERLAP = 5, 0.8
#: Neighbouring items whose postings of a term share one maximum.
BLOCK = 4
#: Test items indexed, broadcast and passed over the documents at once, by bytes of their text.
PASS_BYTES = 4 << 20
LEAST_CHUNK = 64
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))
_ARROW_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; the whole of a shorter text."""
    return {tuple(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's first line and the rest, or the halves of an item of one line."""
    head, _, tail = text.strip().partition("\n")
    first, rest = words(head), words(tail)
    if not rest:
        cut = (len(first) + 1) // 2
        first, rest = first[:cut], first[cut:]
    return first, rest


def indexed_part(text: str) -> list[str]:
    """The words by which an item is searched: the longer of question and answer, so that one that stands apart from the other is found too."""
    question, answer = question_and_answer(text)
    return answer if len(answer) > len(question) else question


def least_score(tokens: list[str], weights: dict[str, float]) -> float:
    """What a passage with OVERLAP of a part's shingles scores at least, if ``weights`` of the part's words add up to 1.

    Where the part repeats no shingle, places may be missing as long as they stand in no more shingles than there are to spare; a
    run inside costs its length and SHINGLE - 1 more, one at an edge its length. The costliest choice is found place by
    place, a word's weight shared by its places. Where shingles repeat, a word is missing with all that hold it, and each holds
    SHINGLE words at most, which bounds the weights that fit. Where that leaves nothing (parts that repeat few words), the words of one
    shingle must still be there, so the bound is above 0.
    """
    want = shingles(tokens)
    spare = int((1 - OVERLAP) * len(want) + 1e-9) if len(tokens) >= SHINGLE else 0
    loss = (_lost_places if len(want) == len(tokens) - SHINGLE + 1 else _lost_words)(tokens, weights, want, spare) if spare else 0.0
    return max(1 - loss, min((sum(weights[w] for w in set(s)) for s in want), default=1.0))


def _lost_places(tokens: list[str], weights: dict[str, float], want: set[tuple[str, ...]], spare: int) -> float:
    """The most weight of places that stand in ``spare`` shingles at most, if all shingles differ."""
    count = Counter(tokens)
    best = np.zeros((SHINGLE + 1, spare + 1))  # by places since the last missing one, SHINGLE for more or none, and shingles lost
    best[:SHINGLE] = -np.inf
    for i, w in enumerate(tokens):
        last = min(i, len(want) - 1)
        missing = np.full(spare + 1, -np.inf)
        for since in range(1, SHINGLE + 1):  # the last missing place is i - since
            cost = max(0, last - max(i - since + 1, 0) + 1)
            if cost <= spare:
                missing[cost:] = np.maximum(missing[cost:], best[since - 1 if since < SHINGLE else slice(SHINGLE - 1, None)].reshape(-1, spare + 1).max(axis=0)[: spare + 1 - cost])
        best[SHINGLE] = np.maximum(best[SHINGLE], best[SHINGLE - 1])
        best[1:SHINGLE] = best[: SHINGLE - 1].copy()
        best[0] = missing + weights[w] / count[w]
    return float(best.max())


def _lost_words(tokens: list[str], weights: dict[str, float], want: set[tuple[str, ...]], spare: int) -> float:
    """No less than the most weight of words that stand in ``spare`` shingles at most."""
    held = Counter(w for s in want for w in set(s))
    loss, left = 0.0, SHINGLE * spare
    for w in sorted((w for w in held if held[w] <= spare), key=lambda w: weights[w] / held[w], reverse=True):
        part = min(1.0, left / held[w])
        loss, left = loss + part * weights[w], left - part * held[w]
    return loss


@dataclass
class Index:
    """Postings of BM25 impacts with their maxima for a term and for a term in a block of items.

    An impact is divided by what a passage must reach: THRESHOLD of the part's score against itself, or less where a passage
    with enough overlap could score less. So an item is retrieved at a sum of 1.
    """

    ids: list[int]
    terms: dict[str, int]
    #: By term: items in order, their impacts, the largest impact, and the largest in each block.
    items: list[list[int]]
    impacts: list[list[float]]
    most: list[float]
    block_most: list[dict[int, float]]
    #: The maxima of blocks once more, term after term, for bounds of whole passages: first place of each term, blocks, maxima.
    start: np.ndarray
    blocks: np.ndarray
    bounds: np.ndarray
    #: The shingles of each item's indexed part and of the other one, and whether the first of them is the answer.
    parts: list[tuple[set, set]] = field(repr=False)
    by_answer: list[bool] = field(repr=False)
    reach: list[float]
    chunk: int

    @classmethod
    def build(cls, items: list[tuple[int, str]], document_frequency: dict[str, int], total: int, mean_length: float, chunk: int) -> Index:
        terms: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        reach = []
        for i, (_, text) in enumerate(items):
            tokens = indexed_part(text)
            counts = Counter(tokens)
            length, row = sum(counts.values()), {}
            for term, tf in counts.items():
                df = document_frequency[term]
                idf = np.log1p((total - df + 0.5) / (df + 0.5))
                row[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
            own = sum(row.values()) or 1.0
            reach.append(min(THRESHOLD, least_score(tokens, {w: x / own for w, x in row.items()})))
            own *= reach[-1]
            for term, x in row.items():
                if term not in terms:
                    terms[term] = len(terms)
                    postings.append([])
                postings[terms[term]].append((i, float(x / own)))
        block_most: list[dict[int, float]] = []
        for row in postings:
            most: dict[int, float] = {}
            for i, x in row:
                most[i // BLOCK] = max(most.get(i // BLOCK, 0.0), x)
            block_most.append(most)
        return cls(
            [i for i, _ in items], terms, [[i for i, _ in row] for row in postings], [[x for _, x in row] for row in postings], [max(x for _, x in row) for row in postings], block_most,
            np.concatenate(([0], np.cumsum([len(m) for m in block_most], dtype=np.int64))), np.array([b for m in block_most for b in m], np.int64), np.array([x for m in block_most for x in m.values()], np.float64),
            [tuple(map(shingles, sorted(question_and_answer(t), key=len, reverse=True))) for _, t in items], [indexed_part(t) != question_and_answer(t)[0] for _, t in items], reach, chunk,
        )

    def candidates(self, tokens: list[str]) -> Iterator[tuple[int, dict[int, float]]]:
        """(passage, items whose part reaches 1 in it, with their scores), for each passage that has any.

        A passage is two chunks of as many words as the longest part of any item, one chunk apart, so that it holds
        any occurrence whole. Passages in which no block of items can reach 1 are dropped together;
        the others are searched one by one.
        """
        none = len(self.terms)
        coded = np.fromiter(map(self.terms.get, tokens, [none] * len(tokens)), np.int64, len(tokens))
        known = np.flatnonzero(coded != none)
        if not len(known):
            return
        chunks = known // self.chunk
        pairs = np.unique(np.concatenate([chunks, chunks - 1]) * (none + 1) + np.tile(coded[known], 2))  # a chunk is in its own passage and in the one before
        passage, term = pairs // (none + 1), pairs % (none + 1)
        n_blocks = -(-len(self.ids) // BLOCK)
        step = min(max(1, (1 << 20) // n_blocks), int(passage[-1] - passage[0]) + 1)  # passages bounded at once
        for low in range(int(passage[0]), int(passage[-1]) + 1, step):
            a, b = np.searchsorted(passage, [low, low + step])
            size = self.start[term[a:b] + 1] - self.start[term[a:b]]
            spot = np.repeat(self.start[term[a:b]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = np.repeat((passage[a:b] - low) * n_blocks, size) + self.blocks[spot]
            reach = np.bincount(cell, weights=self.bounds[spot], minlength=step * n_blocks).reshape(step, n_blocks).max(axis=1)
            for p in np.flatnonzero(reach >= 1 - 1e-9):
                x, y = np.searchsorted(passage, [low + p, low + p + 1])
                found = self.search(term[x:y].tolist())
                if found:
                    yield int(low + p), found

    def search(self, terms: list[int]) -> dict[int, float]:
        """Items in which ``terms`` reach 1, by block-max WAND.

        Cursors stand at the next item of each term, in order. The pivot is the first item that the terms up to it can
        lift to 1 by their largest impacts. Where the maxima of its block fall short, all of them
        jump behind the block (or to the next cursor); else they catch up with the pivot, and only an
        item that all have reached is scored.
        """
        cursors = sorted([self.items[t][0], 0, t] for t in terms)
        found, enough = {}, 1 - 1e-9
        while cursors:
            bound, last = 0.0, -1
            for k, cursor in enumerate(cursors):
                bound += self.most[cursor[2]]
                if bound >= enough:
                    last = k
                    break
            if last < 0:
                break
            pivot = cursors[last][0]
            while last + 1 < len(cursors) and cursors[last + 1][0] == pivot:
                last += 1
            block = pivot // BLOCK
            if sum(self.block_most[c[2]].get(block, 0.0) for c in cursors[: last + 1]) < enough:
                goal = (block + 1) * BLOCK
                if last + 1 < len(cursors):
                    goal = min(goal, cursors[last + 1][0])
            elif cursors[0][0] == pivot:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: last + 1])
                if score >= enough:
                    found[pivot] = score
                goal = pivot + 1
            else:
                goal = pivot
            moved = []
            for cursor in cursors[: last + 1]:
                if cursor[0] < goal:
                    items = self.items[cursor[2]]
                    cursor[1] = bisect_left(items, goal, cursor[1])
                    if cursor[1] == len(items):
                        continue
                    cursor[0] = items[cursor[1]]
                moved.append(cursor)
            cursors = sorted(moved + cursors[last + 1 :])
        return found

    def leaks(self, text: str) -> list[dict]:
        """Items whose indexed part stands in a retrieved passage and whose other part stands anywhere in the text."""
        tokens = words(text)
        held: dict[int, tuple[float, float]] = {}
        for p, found in self.candidates(tokens):
            passage = tokens[max(0, p * self.chunk) : (p + 2) * self.chunk]
            have: dict[int, set] = {}
            for i, score in found.items():
                overlap = _share(self.parts[i][0], passage, have)
                if overlap >= OVERLAP:
                    held[i] = max(held.get(i, (0.0, 0.0)), (overlap, score))
        have, out = {}, []
        for i, (overlap, score) in sorted(held.items()):
            other = _share(self.parts[i][1], tokens, have)
            if other >= OVERLAP:
                question, answer = (other, overlap) if self.by_answer[i] else (overlap, other)
                out.append({"item_id": self.ids[i], "score": round(score * self.reach[i], 6), "question_overlap": question, "answer_overlap": answer})
        return out


def _share(part: set, tokens: list[str], have: dict[int, set]) -> float:
    """The share of a part's shingles that stand in ``tokens``, whose runs are kept in ``have`` by their length."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    if n not in have:
        have[n] = {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}
    return len(part & have[n]) / len(part)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, pass_bytes: int) -> tuple[int, Iterator[Index]]:
    """The number of passes, and the index of each in turn; statistics and passages are those of all items."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("body")).distinct()

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(batch: pa.Array) -> pa.Array:
        return pa.array([indexed_part(t.as_py()) for t in batch], pa.list_(pa.string()))

    coded = items.select("item_id", "body", split("body").alias("tokens")).where(F.size("tokens") > 0)
    total, length, longest, size = coded.agg(F.count("*"), F.sum(F.size("tokens")), F.max(F.size("tokens")), F.sum(F.octet_length("body"))).first()
    passes = -(-size // pass_bytes) if total else 0
    number = F.pmod(F.xxhash64("item_id", "body"), F.lit(max(1, passes)))
    terms = coded.select(number.alias("pass"), F.explode(F.array_distinct("tokens")).alias("term"))
    counts = terms.groupBy("term").count()

    def build() -> Iterator[Index]:
        for p in range(passes):
            rows = [(r[0], r[1]) for r in coded.where(number == p).orderBy("item_id", "body").select("item_id", "body").collect()]
            own = terms.where(F.col("pass") == p).select("term").distinct()
            frequency = {r[0]: r[1] for r in counts.join(own, "term", "left_semi").collect()}
            if rows:
                yield Index.build(rows, frequency, total, length / total, max(LEAST_CHUNK, longest))

    return passes, build()


def _free(df: DataFrame, name: str) -> str:
    """``name``, or the first like it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def find_leaks(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "leaks", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """Add ``out_col``: the test items that a document holds, as an array of (item_id, score, question_overlap, answer_overlap).

    The longer part of each item, question or answer, goes into an inverted index of BM25 impacts. Every
    passage of every text is a query by block-max WAND: all items whose part reaches THRESHOLD of its own score (less
    where a passage with enough overlap could miss it) are retrieved. One counts as leaked where at least OVERLAP of the
    five-word shingles of that part stand in one retrieved passage, and as many of the other part's anywhere in the
    document. No item that this rule counts is missed. A passage is two neighbouring chunks of as many words as the
    longest part of any item (LEAST_CHUNK at least), so it holds any occurrence whole; a part cut into pieces that no
    passage holds together is no leak. Words are compared in lower case without punctuation.

    One pass indexes, collects to the driver and broadcasts about ``pass_bytes`` of items; a larger benchmark takes
    several, one after another, each of which writes what it found by the digest of the text, so that one index is held
    at a time. With one pass the documents are not shuffled.

    Null and empty texts have no leaks; null items and items without words match nothing; items with equal text are
    all reported; rows, ties, repeats and other columns stay; a column named ``out_col`` is replaced; an
    empty benchmark or table gives empty arrays or no rows.
    """
    spark = df.sparkSession
    out = df.drop(out_col)
    passes, indexes = _indexes(benchmark, item_col, item_text_col, pass_bytes)
    if passes <= 1:
        index = next(indexes, None)
        if index is None:
            return out.withColumn(out_col, F.array().cast(LEAK.simpleString()))
        return out.withColumn(out_col, _search(spark.sparkContext.broadcast(index))(F.col(text_col)))
    work, found = Workspace(spark, "leaks"), None
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("body"))
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)
        some = texts.withColumn("leaks", _search(shared)(F.col("body"))).where(F.size("leaks") > 0)
        part = work.save(some.select(F.sha2("body", 256).alias("of"), "leaks").distinct(), "pass")
        shared.destroy()
        found = part if found is None else found.unionAll(part)
    key, at = _free(out, "text_digest"), _free(out, "leak_digest")
    found = found.groupBy(F.col("of").alias(at)).agg(F.sort_array(F.flatten(F.collect_list("leaks"))).alias(out_col))
    met = out.withColumn(key, F.sha2(text_col, 256)).join(found, F.col(key) == F.col(at), "left")
    return met.select(*[out[c] for c in out.columns], F.coalesce(out_col, F.array().cast(LEAK.simpleString())).alias(out_col))


def _search(shared):
    @F.arrow_udf(LEAK)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shared.value.leaks(t) for t in _each(batch)], _ARROW_LEAK)

    return search


def _each(batch: pa.Array) -> Iterator[str]:
    for text in pc.fill_null(batch, ""):
        yield text.as_py()
