"""Exact top-k inner-product search over vectors in descending length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from attestor.session import Workspace

#: Vectors from which the rotation is fitted; it decides only how well bounds prune, never a result.
FIT_VECTORS = 4096
SEED_VECTORS = 1024
QUERY_BLOCK = 8192
VECTOR_BLOCK = 1024
HEAD_DIMS = 16
_EXACT = float(2**53)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, filled with zeros up to ``width``."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products of matching rows; beyond 2**53 with Python integers, held to the range of a long."""
    with np.errstate(over="ignore"):
        reach = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if reach < _EXACT:
        return np.einsum("ij,ij->i", queries, vectors).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for q, v in zip(queries, vectors, strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in out], dtype=np.int64)


def _components(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x), within the range of a double."""
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(scale * _matrix(column, width), -most, most))


class Searcher:
    """Keeps the k best of each query while blocks of vectors pass by in descending length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.queries, self.rotation, self.k = ids, queries, rotation, k
        with np.errstate(over="ignore", invalid="ignore"):
            rotated = queries @ rotation
            self.head, self.rest = rotated[:, :HEAD_DIMS], np.linalg.norm(rotated[:, HEAD_DIMS:], axis=1)
            self.norms = np.linalg.norm(queries, axis=1)
        self.floor = floor.astype(np.float64)  # a score below it is beaten k times already
        self.best_q = np.zeros(0, np.int64)
        self.best_score, self.best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @np.errstate(over="ignore", invalid="ignore")
    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.linalg.norm(vectors, axis=1)
        slack = 1e-6 + 1e-9 * self.norms * norms.max(initial=0)
        active = np.flatnonzero(~(self.norms * norms.max(initial=0) + slack < self.floor))  # what overflows is never pruned
        if not len(active):
            return
        rotated = vectors @ self.rotation
        head, rest = rotated[:, :HEAD_DIMS], np.linalg.norm(rotated[:, HEAD_DIMS:], axis=1)
        for a in range(0, len(active), 256):
            q = active[a : a + 256]
            bound = self.head[q] @ head.T + self.rest[q][:, None] * rest[None, :] + slack[q][:, None]
            i, j = np.nonzero(~(bound < self.floor[q][:, None]) & (self.ids[q][:, None] != ids[None, :]))
            if not len(i):
                continue
            scores = np.concatenate([exact_scores(self.queries[q[i[s : s + 65536]]], vectors[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
            keep = scores >= self.floor[q[i]]
            self._merge(q[i[keep]], scores[keep], ids[j[keep]])

    def _merge(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        q, scores, ids = np.concatenate([self.best_q, q]), np.concatenate([self.best_score, scores]), np.concatenate([self.best_id, ids])
        order = np.lexsort((ids, ~scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], scores[last].astype(np.float64))
        top = rank < self.k
        self.best_q, self.best_score, self.best_id = q[top], scores[top], ids[top]


def _rotation(sample: np.ndarray, width: int) -> np.ndarray:
    """Orthogonal axes by falling share of the inner products: right singular vectors of the sample."""
    if not len(sample):
        return np.eye(width)
    scale = np.abs(sample).max() or 1.0
    return np.linalg.svd(sample / scale, full_matrices=True)[2].T


def top_k(
    df: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    query_block: int = QUERY_BLOCK,
    partitions: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds the ``k`` best other rows.

    Components become floor(scale * x); the score is the exact integer inner product, ties go to the smaller
    id. Vectors are dealt out by descending length. Queries visit them in broadcast blocks of at most
    ``query_block`` rows, each starting with what the longest ``SEED_VECTORS`` already prove; a block of
    vectors is skipped where length times length falls short, then pairs by the first rotated dimensions
    plus Cauchy-Schwarz on the rest, and only what remains is scored.

    Rows whose id or vector is null, or that hold a null, NaN or infinite component, take no part. Shorter
    vectors count as filled with zeros; an empty vector scores 0. Rows that repeat an id are candidates
    each, but not for a query of that id, and as queries each has a list of its own; fewer than ``k`` candidates give fewer rows; an empty table
    gives none. Scores beyond a long are held to its range. Other columns are ignored.
    """
    spark = df.sparkSession
    work = Workspace(spark, "topk")
    value = F.col(vector_col)
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    plain = df.where(F.col(id_col).isNotNull() & value.isNotNull() & whole)
    components = F.transform(value, lambda x: x.cast("double"))
    vectors = plain.select(F.col(id_col).cast("long").alias("id"), components.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    norm = F.aggregate(F.transform("v", lambda x: F.pow(scale * x, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    vectors = vectors.withColumn("norm", norm).repartitionByRange(n, F.desc("norm"), F.asc("id")).sortWithinPartitions(F.desc("norm"), F.asc("id"))
    vectors = work.save(vectors, "by_length")
    width, n_queries = vectors.agg(F.max(F.size("v")), F.count_if("q")).first()
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    if not width and not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width or 0, 1)

    def pull(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = part.select("id", "v").toArrow().combine_chunks()
        if not table.num_rows:
            return np.zeros(0, np.int64), np.zeros((0, width))
        chunk = table.to_batches()[0]
        return np.asarray(chunk.column(0)), _components(chunk.column(1), width, scale)

    rotation = _rotation(pull(vectors.orderBy(F.xxhash64("id")).limit(FIT_VECTORS))[1], width)
    seed_ids, seeds = pull(vectors.orderBy(F.desc("norm"), "id").limit(SEED_VECTORS))
    blocks = max(1, -(-int(n_queries) // query_block))
    found = []
    for b in range(blocks):
        mine = vectors.where("q")
        if blocks > 1:
            mine = mine.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        ids, queries = pull(mine)
        if not len(ids):
            continue
        first = Searcher(ids, queries, rotation, k, np.full(len(ids), -np.inf))
        first.add(seed_ids, seeds)
        shared = spark.sparkContext.broadcast((ids, queries, rotation, first.floor))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, b=b) -> Iterator[pa.RecordBatch]:
            ids, queries, rotation, floor = shared.value
            search = Searcher(ids, queries, rotation, k, floor)
            for batch in batches:
                for a in range(0, batch.num_rows, VECTOR_BLOCK):
                    part = batch.slice(a, VECTOR_BLOCK)
                    search.add(np.asarray(part.column(0)), _components(part.column(1), width, scale))
            yield pa.RecordBatch.from_arrays([pa.array(search.best_q.astype(np.int64) + (b << 32)), pa.array(search.ids[search.best_q]), pa.array(search.best_id), pa.array(search.best_score)], names=["query", "query_id", "vec_id", "score"])

        found.append(work.save(vectors.select("id", "v").mapInArrow(run, schema), f"block{b}"))
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionAll(more)
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
