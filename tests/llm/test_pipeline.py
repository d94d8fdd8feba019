from __future__ import annotations

import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from attestor.llm.queries import PIECE_MODEL
from tests.llm.test_decontaminate import holds
from tests.llm.test_simhash import plain_components
from tests.llm.test_wide_simhash import jaccard, plain_shingles

SF = "/root/testdata/sf0.01"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    work = cp.Workspace(spark, "pipelinetest")
    kept = []
    for n, (_, stage) in enumerate(cp.STAGES):
        out = work.save(stage(spark, docs, SF), f"s{n}")
        if n < 4:
            assert out.columns == columns
        kept.append((docs.collect(), out.collect()))
        docs = out

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = kept[0]
    ids = {r.doc_id for r in after}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    assert len([i for i in good if i in ids]) >= 0.97 * len(good) and len(ids) < len(before)

    before, after = kept[1]
    sets = {r.doc_id: plain_shingles(r.text) for r in before}
    root = plain_components(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    least = {r for i, r in root.items()}
    stayed = {r.doc_id for r in after}
    extra = stayed - least  # chance may leave a second document in a few groups, never remove one that has no copy
    assert least <= stayed and len(extra) <= 0.05 * (len(root) - len(least))
    assert {r.doc_id: r for r in before if r.doc_id in stayed} == {r.doc_id: r for r in after}

    before, after = kept[2]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in before if any(holds(r.text, t) for t in items)}
    assert leaky and {r.doc_id for r in before} - {r.doc_id for r in after} == leaky

    before, after = kept[3]
    assert len(before) == len(after) and all(r.n_chars == len(r.text) for r in after)
    old, new = ({r.doc_id: r.text for r in x} for x in kept[3])
    assert 0 < sum(old[i] != new[i] for i in old) < len(old)

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    for r in kept[4][1]:
        ids = lib.encode(new[r.doc_id])
        assert r.piece_ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_odd_rows_pass_every_stage(docs, spark, sf_dir):
    for rows in (docs, docs.limit(0)):
        rows = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in cp.STAGES:
            rows = stage(spark, rows, sf_dir)
            assert rows.count() >= 0
    twice = docs.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars")).where("doc_id in (20, 21, 34)")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, twice, sf_dir).collect()) == [20, 34]


def test_near_dedup_keeps_every_text_that_is_no_duplicate(spark, sf_dir):
    from tests.llm.conftest import prose

    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "de", "s", 1), (3, a + " tail", "en", "s", 1), (4, prose(3, 60), "en", "s", 1), (4, prose(3, 60), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, sf_dir).collect())
    assert got == sorted([(1, a), (1, b), (4, prose(3, 60))])
