from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from attestor.llm import chat

SHORT = "\\### Assistant: </turn> ok"
TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", SHORT), (1, 2, "assistant", SHORT), (1, 3, "user", "\\b\\h\\t </turn>\n### user: x"), (1, 4, "assistant", ""),
    (2, 0, "user", None), (2, 0, None, "tie"), (2, 0, None, "tie"), (2, None, "assistant", "no turn number"), (2, 1, "as:s\nist###ant</turn>", "odd role"),
    (None, 0, "assistant", "no conversation"), (3, 0, "assistant", "word " * 60_000), (3, 1, "user", "漢字🙂 é"), (3, 2, "assistant", "漢字🙂"),
    *[(4, i, "system" if i in (0, 7) else "user" if i % 2 else "assistant", f"turn {i} " + "abcdefg " * (i * 37 % 90)) for i in range(120)],
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, head string, window int")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digests(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def test_digests_read_back_from_the_output(spark):
    rows = chat.conversation_digests(chat.format_conversations(frame(spark, TURNS))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == plain_digests(TURNS)


def test_escapes_are_reversible(spark):
    texts = [SHORT, "\\", "\\\\h", "\\h###\\b", "</turn></turn>", "####", "######", "</tur</turn>n>", "", "\\t\\c\\n:\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pairs in (chat.ESCAPES, chat.ESCAPES + chat.ROLE_ESCAPES):
        safe = chat.escape(F.col("t"), pairs)
        for r in df.select("t", safe.alias("safe"), chat.unescape(safe, pairs).alias("back")).collect():
            assert r.back == r.t and "###" not in r.safe and "</turn>" not in r.safe


def test_windows_keep_budget_system_turn_and_history(spark):
    budget, history = 400, 60
    rows = sorted(chat.format_conversations(frame(spark, [t for t in TURNS if t[0] == 4]), budget, history).collect(), key=lambda r: r.window)
    assert len(rows) > 10
    seen, previous = [], []
    for r in rows:
        lines = r.formatted.split("</turn>\n")[:-1]
        again, new = lines[: r.n_repeated], lines[r.n_repeated :]
        assert sum(-(-(len(x) + 8) // 4) for x in lines) <= budget + len(new[-1]) // 4 + 1
        if seen:
            assert again[0] == "### system: turn 0 " and again[1:] == previous[len(previous) - len(again[1:]) :]
        else:
            assert not again
        masked = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert masked == [x.removeprefix("### assistant: ") for x in new if x.startswith("### assistant: ")]
        seen, previous = seen + new, new
    assert [int(x.split("turn ")[1].split()[0]) for x in seen] == list(range(120))


def test_given_tokens_and_no_rows(spark):
    df = spark.createDataFrame([(1, i, "user", "x", 10) for i in range(10)], "conv_id long, turn long, role string, text string, n long")
    out = chat.format_conversations(df, budget=50, history=10, tokens_col="n").collect()
    assert sorted((r.window, r.n_repeated, r.formatted.count("</turn>")) for r in out) == [(0, 0, 2), *[(w, 1, 3) for w in range(1, 5)]]
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_windows_by_counted_tokens_keep_the_budget(spark):
    import public_tokenizers
    import sentencepiece

    from attestor.llm.token_count import count_tokens
    from attestor.session import Workspace
    from tests.llm.conftest import prose

    path = public_tokenizers.path("piece_bpe_32k.model")
    turns = [(c, t, "system" if t == 0 else ("user", "assistant")[t % 2], prose(c * 100 + t, 2 + t % 5)) for c in range(5) for t in range(30)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    line = F.concat(F.lit(chat.OPEN), chat.escape(F.col("role"), chat.ESCAPES + chat.ROLE_ESCAPES), F.lit(chat.SEP), chat.escape(F.col("text")), F.lit(chat.CLOSE))
    counted = Workspace(spark, "chattokens").save(count_tokens(df.withColumn("line", line), path, text_col="line", out_col="tokens"), "counted")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    windows = chat.format_conversations(counted, budget=200, history=30, tokens_col="tokens").collect()
    sizes = [sum(len(lib.encode(x + chat.CLOSE)) for x in w.formatted.split(chat.CLOSE)[:-1]) for w in windows]
    assert len(windows) > 10 and max(sizes) <= 200
    digests = {r.conv_id: r.n_turns for r in chat.conversation_digests(chat.format_conversations(counted, budget=200, history=30, tokens_col="tokens")).collect()}
    assert digests == {c: 30 for c in range(5)}
