"""A corpus pipeline of five stages, counted as part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.decontaminate import find_leaks
from attestor.llm.pii import replace_pii
from attestor.llm.piece_spans import encode_pieces
from attestor.llm.quality import classify
from attestor.llm.queries import PIECE_MODEL, PII_KEY
from attestor.llm.wide_simhash import similar_components
from attestor.session import Workspace, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (score of 0.3 or more).

    Null texts count as empty, which has a score like any other; rows without doc_id are scored and train nothing; repeated
    rows stay or go together; an empty table stays empty.
    """
    return classify(docs, read_table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one whose doc_id is smallest, of rows of one id any that is in the group.

    Near-duplicates have sets of five-word shingles with a Jaccard similarity of 0.8 or more, found by wide SimHash
    fingerprints and verified on the texts. Rows are told apart by doc_id and text: rows that repeat an id with other
    texts are documents of their own, of rows that repeat both one stays. Rows without doc_id stay.
    """
    key = F.xxhash64("doc_id", "text").alias("row_key")
    rows = docs.where("doc_id is not null").select(*docs.columns, key)
    groups = similar_components(rows, "row_key").distinct()
    members = rows.select(F.col("row_key").alias("member"), "doc_id").distinct()
    first = groups.join(members, groups.row_key == members.member).groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    whole = rows.join(first.select("first.row_key"), "row_key", "left_semi")
    one = whole.groupBy("doc_id", "row_key").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("row"))
    return one.select("doc_id", "row.*").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; a row goes if the text holds the question and the answer of any.

    Null and empty texts hold none; repeated rows stay or go together; an empty benchmark or table changes nothing.
    """
    return find_leaks(docs, read_table(spark, sf_dir, "benchmark"), out_col="leaks").where(F.size("leaks") == 0).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text.

    Every row stays: null and empty texts as they are, repeated rows alike, a null n_chars null.
    """
    out = replace_pii(docs, PII_KEY, count_col=None)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, their end offsets in bytes, and a digest of what they decode to.

    Every row stays; null and empty texts have no pieces, whatever repeats is encoded alike, an empty table stays empty.
    """
    out = encode_pieces(docs, public_tokenizers.path(PIECE_MODEL))
    return out.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids", "piece_ends", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII surrogates", pii),
    ("SentencePiece encoding", encode),
]
#: Learned scores, SimHash and piece ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on what its predecessor wrote."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{n}")
    return docs
