"""Fences, sections and endpoint facts against a reader that goes line by line."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from attestor.operators import facts, tables
from attestor.session import Workspace


def read_fences(text):
    """(opened, closed) of each fence, and for each line whether it is inside, a mark or outside."""
    spans, roles, mark = [], [], None
    for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1):
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if mark is None:
            if m:
                mark, spans = m[1], [*spans, [i, None]]
            roles.append("mark" if m else "outside")
        elif m and not m[2].strip() and m[1][0] == mark[0] and len(m[1]) >= len(mark):
            spans[-1][1], mark = i, None
            roles.append("mark")
        else:
            roles.append("inside")
    return spans, roles


def texts():
    r = random.Random(3)
    parts = ["```", "````", "~~~", "~~~~~", "```json", "~~~ x", "   ```", "    ```", "# Head", "## Sub ##", "GET /a", "POST /b/{id}", "| Name | T |", "| --- | --- |", "| one | x |", "| two (opt) | y |", "prose", "", "\t# no"]
    return [(i, "\n".join(r.choice(parts) for _ in range(r.randrange(0, 40)))) for i in range(150)] + [(200, "```\n~~~\n```"), (201, "~~~\r\n```\r\n~~~\r\nx"), (202, ""), (203, "```" * 3)]


def test_fences(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: [(s.opened, s.closed) for s in r.spans] for r in df.select("id", facts.fence_spans(F.col("text")).alias("spans")).collect()}
    assert got == {i: [tuple(s) for s in read_fences(t)[0]] for i, t in rows}
    marked = {(r.source, r.line): "inside" if r.in_fence else "mark" if r.is_marker else "outside" for r in facts.marked_lines(df, "id", "text").collect()}
    assert marked == {(i, n): role for i, t in rows for n, role in enumerate(read_fences(t)[1], 1)}
    unclosed = {r.source: r.opened for r in facts.unclosed_fences(df, "id", "text").collect()}
    assert unclosed == {i: s[-1][0] for i, t in rows if (s := read_fences(t)[0]) and s[-1][1] is None}


def owners(text):
    """The endpoint that each line belongs to: the last declared, until a heading of the level above it or higher."""
    out, roles, heading, owner, level = [], read_fences(text)[1], 99, None, None
    for line, role in zip(text.split("\n"), roles):
        m = re.match(r" {0,3}(#{1,6})[ \t]+", line) if role == "outside" else None
        if m:
            if owner and len(m[1]) <= level:
                owner = None
            heading = len(m[1])
        e = re.match(r"(GET|POST) (/\S*)$", line) if role == "outside" else None
        if e:
            owner, level = (e[1], e[2]), heading
        out.append(owner)
    return out


def test_sections(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "id int, text string")
    got = {(r.source, r.line): tuple(r.owner) if r.owner else None for r in facts.section_owner(facts.marked_lines(df, "id", "text")).collect()}
    want = {(i, n): o for i, t in rows if i != 201 for n, o in enumerate(owners(t), 1)}
    assert {k: v for k, v in got.items() if k[0] != 201} == want and any(want.values())


def test_endpoint_facts(spark):
    text = "# A\nGET /x\n| Name | T |\n|---|---|\n| one | s |\n| `two` (optional) | s |\n~~~text\n```\n| Name | T |\n| --- | --- |\n| fake | s |\n~~~\n```json\n{}\n```\n## Sub\n| Code | M |\n| --- | --- |\n| E1 | no |\n# B\nPOST /y\n| Field |\n| --- |\n| three |"
    rows = facts.endpoint_facts(spark.createDataFrame([("s", text)], "id string, text string"), "id", "text").collect()
    assert {(r.method, r.path): (r.line, r.last_line, r.n_fences, tuple(r.parameters)) for r in rows} == {("GET", "/x"): (2, 19, 2, ("one", "two")), ("POST", "/y"): (21, 24, 0, ("three",))}


def plain_fences(text):
    """Fences of an endpoint's section that hold an example, line by line."""
    out, rows, endpoint, i = [], text.splitlines(), None, 0
    while i < len(rows):
        mark = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", rows[i])
        if not mark:
            if rows[i].startswith("# "):
                endpoint = None
            elif rows[i].startswith("GET /"):
                endpoint = rows[i][4:]
            i += 1
            continue
        start, content, end, i = i + 1, [], i + 1, i + 1
        while i < len(rows):
            close = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", rows[i])
            end, i = i + 1, i + 1
            if close and not close[2].strip() and close[1].startswith(mark[1]):
                break
            content.append(rows[end - 1])
        info, first = mark[2].strip().lower(), next((x.strip()[0] for x in content if x.strip()), "")
        if endpoint and (info in facts.PAYLOADS or first and first in "{[<"):
            out.append((endpoint, info, start, end, "\n".join(content).strip("\n")))
    return out


def test_payload_fences_equal_a_reader(spark):
    r = random.Random(12)
    bits = ["# H", "GET /a", "GET /b/c", "```", "````", "~~~", "``` json", "```JSON ", "~~~ text", "{x", "  [1]", "<a>", "plain", "", "   ", "```` http"]
    texts = ["\n".join(r.choice(bits) for _ in range(r.randrange(1, 16))) + r.choice(["", "\n", "\n\n"]) for _ in range(400)] + ["", None]
    got = facts.payload_fences(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), "id", "body").collect()
    want = sorted((i, p, *f[:3]) for i, t in enumerate(texts) if t for p, *f in plain_fences(t))
    assert sorted((g.source, g.path, g.info, g.start_line, g.end_line) for g in got) == want and len(want) > 50
    told = {(i, f[2]): f[4] for i, t in enumerate(texts) if t for f in plain_fences(t)}
    assert all(g.excerpt == re.sub(r"[ \t]+(?=\n|$)", "", told[g.source, g.start_line]).strip("\n") for g in got)


def test_only_landmarks_are_shuffled(spark, monkeypatch):
    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: saved.append(save(self, df, name)) or saved[-1])
    text = "prose\n" * 50 + "# A\nGET /x\n" + "prose\n" * 50 + "| Name |\n| --- |\n| one |\n\nsay\n| Name |\n| --- |\n| two |\n" + "prose\n" * 20 + "end"
    df = spark.createDataFrame([(1, text), (2, "| a |\n| URL | /y | Method | POST |\n| --- |\n| b |"), (3, "prose\n\nTitle\n-----\nGET /z\nlast"), (4, None), (5, "")], "id int, text string")
    got = sorted((r.source, r.path, r.line, r.last_line, r.parameters) for r in facts.endpoint_facts(df, "id", "text").collect())
    assert got == [(1, "/x", 52, 131, ["one", "two"]), (2, "/y", 2, 4, []), (3, "/z", 5, 6, [])]
    assert saved[0].where("source = 1").count() == 9
    assert "Exchange" not in facts.marked_lines(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    marked = facts.marked_lines(df, "id", "text")
    some = {(r.source, r.line): r.owner for r in facts.section_owner(facts.landmarks(marked)).collect()}
    every = {(r.source, r.line): r.owner for r in facts.section_owner(marked).collect()}
    assert some == {k: every[k] for k in some}
    assert sorted(map(str, tables.tables(facts.section_owner(facts.landmarks(marked))).collect())) == sorted(map(str, tables.tables(facts.section_owner(marked)).collect()))
