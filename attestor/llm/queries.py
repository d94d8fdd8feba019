"""The queries of the dealt operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.session import Workspace, read_table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
BYTE_MODEL = "byte_bpe_50k.json"
#: Key of the surrogates; a real job takes it from a secret store.
PII_KEY = "attestor-example-key"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.simhash import simhash_components

    return simhash_components(read_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.inner_product import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.row_id, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.token_count import count_tokens

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path(PIECE_MODEL), limit=4096)
    return out.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", "over_limit")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.quality import classify

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.piece_spans import encode_pieces

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_pieces(docs, public_tokenizers.path(PIECE_MODEL))
    return out.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("piece_ends", F.lit(-1)), F.lit(0)).cast("long").alias("covered_bytes"),
    )


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``pages`` is one record, archived and read back; rows that repeat are records of their own.

    The page_id travels as a line of the HTTP header (left out if null; null ids come last, and a revisit of such a page
    refers to null). Of rows that repeat an id and payload one is the response, the others revisit it.
    """
    from attestor.llm import warc

    work = Workspace(spark, "warc")
    key = "X-Page-Id"
    built = warc.arc_archives(read_table(spark, sf_dir, "pages"), F.col("url"), F.col("html"), F.when(F.col("page_id") % 2 == 0, 1).otherwise(2), {key: F.col("page_id")})
    archives = work.save(built, "arc")
    page = F.regexp_extract(F.col("head").cast("string"), rf"\r\n{key}: (-?[0-9]+)\r\n", 1)
    heads = warc.convert_arc(archives, with_payload=False).withColumn("page_id", page.try_cast("long"))
    revisits = work.save(warc.first_copies(heads, "page_id", work), "revisits")
    path = work.new_path("archives")
    warc.write_warc(warc.convert_arc(archives), revisits, path)
    read = work.save(warc.read_warc(spark, path, with_payload=False).where("warc_type != 'warcinfo'").drop("payload"), "read")
    found = F.regexp_extract(F.concat("head", F.lit("\r\n")), rf"\r\n{key}: (-?[0-9]+)\r\n", 1).try_cast("long")
    pages = read.select(found.alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "record_id", F.col("refers_to").alias("first_id"))
    firsts = pages.select(F.col("record_id").alias("id"), F.col("page_id").alias("refers_to"))
    met = pages.join(firsts, pages.first_id == firsts.id, "left")
    return met.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.repeats import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm import chat

    text = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(chat.format_conversations(turns))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *,
  (6 + 8 + length(replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'), chr(10), '\n'))
   + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')))::BIGINT AS chars FROM c),
o AS (SELECT *, row_number() OVER w AS ord,
  coalesce(sum(ceil(chars / 4.0)::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, start // 896 AS win FROM o),
spans AS (SELECT conv_id, win, min(start) AS first_start, lag(win) OVER (PARTITION BY conv_id ORDER BY win) AS prev FROM s GROUP BY conv_id, win),
sys AS (SELECT conv_id, min(ord) AS ord, min_by(win, ord) AS win, min_by(chars, ord) AS chars FROM s WHERE role = 'system' GROUP BY conv_id),
kept AS (SELECT p.conv_id, sum(sys.chars) AS chars FROM spans p JOIN sys ON sys.conv_id = p.conv_id AND sys.win < p.win GROUP BY p.conv_id),
hist AS (SELECT p.conv_id, sum(s.chars) AS chars FROM spans p JOIN s ON s.conv_id = p.conv_id AND s.win = p.prev AND s.start >= p.first_start - 256
         LEFT JOIN sys ON sys.conv_id = p.conv_id WHERE sys.ord IS NULL OR sys.ord <> s.ord GROUP BY p.conv_id),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM s GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (g.chars + coalesce(kept.chars, 0) + coalesce(hist.chars, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN kept ON kept.conv_id = g.conv_id LEFT JOIN hist ON hist.conv_id = g.conv_id
"""


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.decontaminate import find_leaks

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.*")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.pii import replace_pii

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, PII_KEY).select("doc_id", "text", F.col("n_entities").cast("long").alias("n_entities"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.impact_index import rank_documents

    return rank_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"), k=50)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
t AS (SELECT row_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT row_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
lengths AS (SELECT row_id, sum(tf)::BIGINT AS n FROM c GROUP BY row_id),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
m AS (SELECT row_id, 100 - 50 + ((50 * n * big_n) // big_l) AS m FROM lengths, totals),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, totals GROUP BY term, big_n),
q AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
i AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q),
s AS (SELECT item, item_id, row_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM i JOIN c USING (term) JOIN w USING (term) JOIN m USING (row_id) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
      FROM s JOIN d USING (row_id) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.byte_bpe import decode_bytes, encode_bytes

    ranks = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    coded = decode_bytes(encode_bytes(read_table(spark, sf_dir, "documents").select("doc_id", "text"), *ranks).drop("text"), *ranks)
    n = (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n, F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.align import align_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokenizers(docs, public_tokenizers.path(BYTE_MODEL), public_tokenizers.PATTERN, public_tokenizers.path(PIECE_MODEL)).drop("key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_exact_top_k, op3_token_counts, op4_warc_archive, op5_quality_classifier, op6_sentencepiece_spans, op7_repeated_strings, op8_chat_windows, op9_benchmark_leaks, op10_pii_surrogates, op11_ranked_search, op12_byte_bpe, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op4_warc_archive": OP4_SQL, "op8_chat_windows": OP8_SQL, "op11_ranked_search": OP11_SQL}
