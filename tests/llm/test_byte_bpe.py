"""Byte-level BPE against its libraries."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    from attestor.llm.byte_bpe import byte_bpe

    ranks = byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ids
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def coded(name: str, text: str) -> list[int]:
    from array import array

    from attestor.llm.byte_bpe import byte_bpe

    return list(array("I", b"".join(byte_bpe(P.path(name), P.PATTERN).encode(text))))


def odd_texts() -> list[str]:
    r = random.Random(5)
    signs = "aaabcdeth in.,'s \t\n\r  #=_0123é漢字🙂​ ßñ<|endoftext|>"
    return ["", " ", "\n\n  x", "a" * 5000, "ab" * 2000, "=" * 777, "don't we'll", "<|endoftext|> x", "漢字" * 300] + ["".join(r.choice(signs) for _ in range(r.randint(1, 400))) for _ in range(300)]


def test_ids_are_the_libraries(library):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in odd_texts():
        assert coded("byte_bpe_50k.tiktoken", text) == library.encode_ordinary(text)
        assert coded("byte_bpe_50k.json", text) == other.encode(text, add_special_tokens=False).ids


def test_a_pre_token_of_a_million_bytes(library):
    from attestor.llm.byte_bpe import byte_bpe

    r = random.Random(2)
    text = "".join(r.choice("abcdefgh") for _ in range(1_000_000))
    ids = coded("byte_bpe_50k.tiktoken", text)
    assert b"".join(library.decode_single_token_bytes(i) for i in ids).decode() == text
    assert ids[:20_000] == library.encode_ordinary(text[:60_000])[:20_000]
    assert not byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).buckets


def test_text_longer_than_a_step(library, monkeypatch):
    from attestor.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "STEP", 7)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    for text in odd_texts()[-40:]:
        assert coded("byte_bpe_multi_50k.tiktoken", text) == coded("byte_bpe_multi_50k.tiktoken", text)
        assert coded("byte_bpe_50k.tiktoken", text) == library.encode_ordinary(text)


def test_operator_on_odd_rows(spark, docs, texts, no_docs, library):
    from attestor.llm.byte_bpe import decode_bytes, encode_bytes

    ranks = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    out = decode_bytes(encode_bytes(docs.withColumnRenamed("fp", "token_ids"), *ranks, batch_bytes=500), *ranks, batch_bytes=700)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "token_ids", "decoded"]
    got = Counter((r.doc_id, r.text, bytes(r.token_ids), bytes(r.decoded)) for r in out.collect())
    want = Counter((i, t, b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts)
    assert got == want
    assert decode_bytes(encode_bytes(no_docs, *ranks), *ranks).count() == 0


def test_query(spark, sf_dir, library):
    import array

    from attestor.llm.queries import queries

    got = {r.doc_id: r for r in queries()["op12_byte_bpe"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
