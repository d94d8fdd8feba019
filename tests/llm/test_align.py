"""Alignment of two tokenizers against a plain search over all pairs of tokens."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x]
    of = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}

    def tokens(text):
        """(id, bytes) of A and of B; none where their bytes are not a space and the text."""
        if not text:
            return [], []
        whole = b" " + text.encode()
        left = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        same = all(b"".join(x for _, x in side) == whole for side in (left, right))
        return (left, right) if same else ([], [])

    return tokens


def plain(rows, tokens):
    """The contract, pair by pair."""
    docs, holders = [], defaultdict(int)
    for doc, text in rows:
        sides = tokens(text)
        spans = []
        for side in sides:
            at, out = 0, []
            for i, raw in side:
                out.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(out)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        links = Counter()
        groups, rest = [], [list(reversed(s)) for s in spans]
        for end in ends:
            inside = [[], []]
            for part, side in zip(inside, rest, strict=True):
                while side and side[-1][0] < end:
                    part.append(side.pop())
            groups.append("|".join(",".join(str(i) for *_, i in s) for s in inside))
            links.update((x[2], y[2]) for x in inside[0] for y in inside[1] if x[0] < y[1] and y[0] < x[1])
        for pair in links:
            holders[pair] += 1
        docs.append((doc, [len(s) for s in sides], groups, links))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    out = Counter()
    for doc, (n_a, n_b), groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        n_best = sum(n for p, n in links.items() if holders[p] == most[p[0]])
        out[doc, n_a, n_b, len(groups), sum(links.values()), n_best, sum(n * holders[p] for p, n in links.items()), digest] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
FILES = (P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))


def test_odd_rows(spark, docs, texts, no_docs, both):
    from attestor.llm.align import align_tokenizers

    got = Counter(tuple(r) for r in align_tokenizers(docs.withColumnRenamed("fp", "key"), *FILES).select(*COLUMNS).collect())
    assert got == plain(texts, both)
    assert align_tokenizers(no_docs, *FILES).count() == 0


def test_blocks_that_cut_groups_and_passes_over_the_counts(spark, both):
    from attestor.llm import align
    from attestor.session import Workspace

    r = random.Random(3)
    signs = "aaabcdeth in.,'s \t\n  #0123é漢字🙂ßñ"
    rows = [(i % 9, "".join(r.choice(signs) for _ in range(r.randint(1, 300)))) for i in range(40)]
    out = []
    for n, (_, text) in enumerate(rows):
        for side, (ids, widths) in enumerate(align.both_tokens(text, *FILES) or ()):
            for s in range(0, len(ids), 3):  # three ends a block
                out.append((n, rows[n][0], side, int(widths[:s].sum()), align._pack(ids[s : s + 3], widths[s : s + 3])))
    events = spark.createDataFrame(r.sample(out, len(out)), "key long, doc_id long, side int, at long, body binary")
    work = Workspace(spark, "test")
    made = work.save(align.align(events), "aligned")
    got = align.score_links(made, work, broadcast_pairs=20)
    want = plain(rows, both)
    found = Counter((x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, hashlib.sha256(x.groups.encode()).hexdigest()) for x in got.collect())
    assert found == want


def test_pairs_counted_together_and_wide_numbers(monkeypatch):
    from attestor.llm import align

    monkeypatch.setattr(align, "LOOSE_PAIRS", 4)
    sweep = align.Sweep(1, 2)
    for n in range(30):
        for side in (0, 1):
            sweep.feed(side, n * 2, np.array([n % 3, 70_000]), np.array([1, 1]))
    row = sweep.row()
    assert row[2:6] == (60, 60, 60, 60)
    assert dict(zip(zip(row[7].tolist(), row[8].tolist(), strict=True), row[9].tolist(), strict=True)) == {(0, 0): 10, (1, 1): 10, (2, 2): 10, (70_000, 70_000): 30}
    ids, widths = np.array([1, 70_000]), np.array([300, 2])
    assert [x.tolist() for x in align._unpack(align._pack(ids, widths))] == [[1, 70_000], [300, 2]]


def test_query(spark, sf_dir, both):
    from attestor.llm.queries import queries

    got = queries()["op13_tokenizer_alignment"](spark, sf_dir)
    assert sorted(got.columns) == sorted(COLUMNS)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == plain(rows, both)


def test_words_that_come_again_are_encoded_once(monkeypatch):
    import sentencepiece

    from attestor.llm import align

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    asked = []

    class Counted:
        def encode(self, text):
            asked.append(len(text))
            return library.encode(text)

    monkeypatch.setattr(align, "sentencepiece_model", lambda path: Counted())
    align._piece_words.cache_clear()
    for text in ("alpha beta gamma " * 500, "beta  gamma alpha", "gamma beta"):
        found = align.both_tokens(text, P.path("byte_bpe_50k.json"), P.PATTERN, path)
        assert found[1][0].tolist() == library.encode(text)
    assert sum(asked) < 100
    r, parts = random.Random(5), [" ", "  ", "a", "ab", "the", "\n", "\t", "▁", "é", "中文", "　", " ", "\0", "😀", ".", "▁ ", "</s>", "<0x41>", "x" * 60]
    monkeypatch.setattr(align, "REMEMBERED_WORDS", 50)
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(1, 12)))
        assert align._piece_ids(text, path).tolist() == library.encode(text)
    align._piece_words.cache_clear()
