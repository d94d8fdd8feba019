from __future__ import annotations

import math
import random
from collections import Counter

from attestor.llm import decontaminate as dc
from tests.llm.conftest import prose

R = random.Random(4)
ITEMS = [(i, f"Which {prose(500 + i, 14)}?\nAnswer: {prose(900 + i, 12)}") for i in range(40)] + [(50, f"One line {prose(40, 20)}"), (51, "Short item"), (52, f"Which {prose(500, 14)}?\nAnswer: {prose(900, 12)}")]
NULLS = [(None, "no id " + prose(2, 9)), (60, None), (61, ""), (62, "?!")]


def plain_shingles(tokens):
    return {" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


CHUNK = max(64, *(len(p) for _, t in ITEMS for p in dc.question_and_answer(t)))


def stands(part, have):
    want, n = plain_shingles(part), min(5, len(part))
    there = {" ".join(have[i : i + n]) for i in range(len(have) - n + 1)}
    return sum(w in there for w in want) >= 0.8 * len(want)


def holds(text, item):
    """Whether at least 0.8 of the shingles of the longer part stand in some passage, and of the other part in the text."""
    have = dc.words(text or "")
    other, longer = sorted(reversed(dc.question_and_answer(item)), key=len)
    return stands(other, have) and any(stands(longer, have[max(0, a) : a + 2 * CHUNK]) for a in range(-CHUNK, len(have), CHUNK))


def documents():
    rows = [(i, prose(2000 + i, 60 + 13 * i)) for i in range(20)]
    for k, (_, text) in enumerate(ITEMS[:30]):
        rows.append((100 + k, f"{prose(3000 + k, R.randrange(0, 700))} {text.upper() if k % 3 else text} {prose(4000 + k, 50)}"))
        rows.append((200 + k, f"{prose(5000 + k, 80)} {text.splitlines()[0]} {prose(6000 + k, 80)}"))  # the question only
    for k in (3, 8, 11):  # questions first, answers a long way on
        question, answer = ITEMS[k][1].splitlines()
        rows.append((400 + k, f"{question} {prose(7000 + k, 900)} {answer}"))
    for k, (_, text) in enumerate(ITEMS[:40]):  # words lost at the edges, or one inside
        question, answer = (x.split() for x in text.splitlines())
        rows.append((500 + k, f"{prose(8000 + k, 40)} {' '.join(question[1 + k % 3 :])} {' '.join(answer[: len(answer) - k % 2])} {prose(8500 + k, 40)}"))
        rows.append((600 + k, f"{prose(9000 + k, 40)} {' '.join([*question[:7], 'other', *question[8:]])} {' '.join(answer)}"))
    for k, gap in ((12, 10), (13, 4000)):  # a question cut in two, within a passage and far beyond
        question, answer = ITEMS[k][1].splitlines()
        cut = question.split()
        rows.append((700 + k, f"{' '.join(cut[:8])} {prose(9500 + k, gap)} {' '.join(cut[3:])} {answer}" if gap == 10 else f"{' '.join(cut[:8])} {prose(9500 + k, gap)} {' '.join(cut[8:])} {answer}"))
    rows += [(300, ITEMS[40][1]), (301, f"a {ITEMS[41][1]} b"), (302, None), (303, ""), (304, prose(9, 40_000) + " " + ITEMS[5][1] + " " + prose(10, 9000)), (305, ITEMS[7][1]), (305, ITEMS[7][1])]
    return rows


def found(spark, docs, items, **args):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, leaks string, text_digest int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.find_leaks(df, bench, **args).collect()
    assert len(rows) == len(docs)
    return sorted((r.doc_id, x.item_id) for r in rows for x in r.leaks)


def test_equals_every_item_against_every_document(spark):
    docs = documents()
    want = sorted((d, i) for d, t in docs for i, item in ITEMS if holds(t, item))
    assert len(want) > 30 and (100, 0) in want and (100, 52) in want and (304, 5) in want and {(403, 3), (408, 8), (411, 11)} <= set(want) and not any(200 <= d < 300 for d, _ in want)
    assert (712, 12) in want and (713, 13) not in want
    assert found(spark, docs, ITEMS + NULLS) == want
    assert found(spark, docs, ITEMS + NULLS, pass_bytes=900) == want  # five passes


def test_no_items_and_no_documents(spark):
    assert found(spark, documents()[:3], NULLS[1:]) == []
    assert found(spark, documents()[:3], []) == []
    assert found(spark, [], ITEMS) == []


def test_what_is_skipped_is_no_candidate():
    parts = [dc.indexed_part(t) for _, t in ITEMS]
    df = Counter(w for p in parts for w in set(p))
    mean = sum(map(len, parts)) / len(parts)
    index = dc.Index.build(ITEMS, df, len(ITEMS), mean, max(dc.LEAST_CHUNK, *map(len, parts)))

    def impacts(tokens):
        counts, out = Counter(tokens), {}
        for w, tf in counts.items():
            idf = math.log1p((len(ITEMS) - df[w] + 0.5) / (df[w] + 0.5))
            out[w] = idf * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(tokens) / mean))
        return out

    weights = [impacts(p) for p in parts]

    def scores(have):
        return {i: s / index.reach[i] for i, w in enumerate(weights) if (s := sum(x for k, x in w.items() if k in have) / sum(w.values())) >= index.reach[i] - 1e-9}

    for _, text in documents():
        tokens, want = dc.words(text or ""), {}
        for p in range(-1, len(tokens) // index.chunk + 1):
            for i, s in scores(set(tokens[max(0, p * index.chunk) : (p + 2) * index.chunk])).items():
                want[p, i] = s
        got = {(p, i): s for p, found in index.candidates(tokens) for i, s in found.items()}
        assert want.keys() == got.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    r = random.Random(6)
    for _ in range(300):  # any set of words, which stage by stage bounds can't tell from a passage
        some = r.sample(sorted(index.terms), r.randrange(1, len(index.terms)))
        got, want = index.search([index.terms[w] for w in some]), scores(set(some))
        assert want.keys() == got.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_enough_overlap_always_reaches_the_least_score():
    r = random.Random(8)
    for n in range(400):
        tokens = [f"w{r.randrange(40 if n < 300 else 4)}" for _ in range(r.randrange(1, 45))]
        raw = {w: r.random() ** 3 + 0.01 for w in set(tokens)}
        weights = {w: x / sum(raw.values()) for w, x in raw.items()}
        least = dc.least_score(tokens, weights)
        assert least > 0
        for _ in range(60):
            gone = set(r.sample(range(len(tokens)), r.randrange(0, min(len(tokens), 8) + 1)))
            if r.random() < 0.5:
                gone = set(range(r.randrange(0, 6))) | {len(tokens) - 1 - i for i in range(r.randrange(0, 6))}
            have = ["" if i in gone else w for i, w in enumerate(tokens)]
            want, there = dc.shingles(tokens), dc.shingles(have)
            if sum(s in there for s in want) >= dc.OVERLAP * len(want):
                assert sum(x for w, x in weights.items() if w in have) >= least - 1e-9


def test_a_run_of_heavy_words_inside_may_be_missing():
    tokens = [f"w{i}" for i in range(44)]  # 40 shingles, 8 to spare: four words in a row
    weights = {w: (10 if 20 <= i < 24 else 1) / 80 for i, w in enumerate(tokens)}
    assert abs(dc.least_score(tokens, weights) - 0.5) < 1e-9
    again = [*tokens[:20], *tokens[:20], "x"]  # the same shingles twice: a word is missing at both places
    lost = [w for i, w in enumerate(again) if i % 20 in (8, 9)]
    there = dc.shingles(["" if w in lost else w for w in again])
    assert sum(s in there for s in dc.shingles(again)) < dc.OVERLAP * len(dc.shingles(again)) or dc.least_score(again, {w: 1 / 21 for w in set(again)}) <= 1 - len(set(lost)) / 21
