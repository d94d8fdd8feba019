from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attestor.llm import token_count
from attestor.llm.char_map import CharMap, normalise, rewrite
from attestor.llm.piece_spans import encode_pieces, piece_ends
from attestor.llm.tokenizer_io import by_bytes, json_splits_at_spaces, n_bytes, split_text, splits_at_spaces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(docs, texts, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(lib.encode(t or "")) for _, t in texts]
    else:
        lib = Tokenizer.from_file(path)
        want = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in texts]
    rows = token_count.count_tokens(docs, path, out_col="score", limit=50, piece_chars=500).collect()
    assert sorted((str(r.doc_id), r.score) for r in rows) == sorted((str(i), n) for (i, _), n in zip(texts, want))
    assert all(r.over_limit == (r.score > 50) for r in rows)


def test_split_pieces_tile_the_text(texts):
    assert splits_at_spaces(MODEL)
    for _, t in texts:
        assert " ".join(split_text(t or "", MODEL, 50)) == (t or "")


def test_batches_are_bounded_by_bytes():
    texts = ["a" * 10, "é" * 10, "漢" * 10, "b" * 5, "c" * 50, "d"]
    sizes = [n_bytes(t) for t in texts]
    assert sizes == [len(t.encode()) for t in texts]
    parts = list(by_bytes(sizes, 40))
    assert [i for a, b in parts for i in range(a, b)] == list(range(6)) and all(b - a == 1 or sum(sizes[a:b]) <= 40 for a, b in parts)


def test_json_tokenizers_are_cut_only_with_proof(tmp_path):
    import json

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        made = json.load(open(public_tokenizers.path(name)))
        assert json_splits_at_spaces(public_tokenizers.path(name))
        for k, change in enumerate([{"normalizer": {"type": "StripAccents"}}, {"pre_tokenizer": {"type": "Metaspace"}}, {"added_tokens": [*made["added_tokens"], made["added_tokens"][0] | {"content": "new york"}]}, {"pre_tokenizer": None}]):
            path = tmp_path / f"{k}-{name}"
            path.write_text(json.dumps(made | change))
            assert not json_splits_at_spaces(str(path)) and split_text("one two " * 99, str(path), 50) == ["one two " * 99]


def test_unknown_kind_is_refused(docs):
    with pytest.raises(ValueError):
        token_count.count_tokens(docs, "x.bin")


def test_empty_table(no_docs):
    assert token_count.count_tokens(no_docs, MODEL).count() == 0
    assert encode_pieces(no_docs, MODEL).count() == 0


def test_pieces_spans_and_decoding(docs, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = encode_pieces(docs.withColumnRenamed("fp", "decoded"), MODEL, batch_bytes=4000).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        r, data = by[i][0], (t or "").encode()
        assert r.piece_ids == lib.encode(t or "") and r.decoded == lib.decode(r.piece_ids)
        assert list(r.piece_ends) == sorted(r.piece_ends) and (not data or r.piece_ends[-1] == len(data))
        start = 0
        for piece, end in zip(r.piece_ids, r.piece_ends):
            surface = lib.id_to_piece(piece).replace("▁", " ")
            if not lib.is_byte(piece) and start:  # the first may hold the dummy prefix
                assert data[start:end].replace("▁".encode(), b" ") == surface.encode()  # a text may hold the mark itself
            start = end
        assert r.source == "s"


def test_compiled_map_equals_the_library_normaliser():
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(norm.serialized_model_proto())
    char_map = CharMap(proto.normalizer_spec.precompiled_charsmap)
    assert char_map
    for text in ["ﬁne ①②  ｆｕｌｌ　width", "  lead and trail  ", "ΐ Å ㌔ x", "", "   ", "abc", "カ゛ガ ｶﾞ"]:
        data = text.encode()
        out, source = normalise(data, char_map, True, True, True)
        assert out.decode() == norm.normalize(text)
        assert len(source) == len(out) + 1 and all(a <= b for a, b in zip(source, source[1:])) and source[-1] <= len(data)
    text, source = rewrite("aﬁb".encode(), char_map)
    assert text == b"afib" and source.tolist() == [0, 1, 1, 4, 5]


def test_pieces_that_do_not_tile_are_refused():
    import numpy as np

    with pytest.raises(ValueError):
        piece_ends("abc", np.array([300, 301]), MODEL)


def test_digests_of_the_query(spark, sf_dir):
    from attestor.llm.queries import op6_sentencepiece_spans

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in op6_sentencepiece_spans(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = lib.encode(d.text)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.covered_bytes) == (len(ids), len(d.text.encode()))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
