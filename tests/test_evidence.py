"""Evidence fragments, each kind by hand and against a reader in plain Python."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pytest

from attestor.operators import evidence

GUIDE = """# API
intro\r
## Auth
keys

## Errors
### Codes
E1
# Other
## Auth
again
<!-- page: 1 -->

one\x0bone and a half
<!-- PAGE : 2 -->
two   two
<!-- page: 1 -->
more
<!-- page: 3 -->
"""
DOCS = [("g.md", GUIDE), ("a.json", json.dumps({"a/b": [1, {"c~": "é"}], "n": None})), ("bad.json", "{"), ("null.md", None), ("empty.md", ""), ("unasked.md", "x")]
ASKED = [
    ("g.md", r) for r in ("g.md lines 1-2", " G line 2-4 ", "g.md lines 0-2", "g.md lines 3-2", "g.md lines 3-400", "g.md lines 1-99999999999", "lines 1-2", "g.md page 1", "g.md p.2", "g p.3", "g page 4", "css:#a", "xpath://a", "section:", "section: Errors > Codes", "section:Auth", "section:API > Auth", "section:Codes>Errors", "section:Other", "nothing")
] + [("a.json", r) for r in ("a.json#", "a.json#/a~1b/1/c~0", "A.YAML#/n", "a.json#/a~1b/2", "a.json#x", "a.json#/zz")] + [("bad.json", "bad.json#"), ("null.md", "n p.1"), ("empty.md", "e lines 1-1"), ("gone.md", "gone.md lines 1-1")]


def normalized(text):
    rows = [x.rstrip(" \t") for x in unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while rows and not rows[0]:
        rows.pop(0)
    while rows and not rows[-1]:
        rows.pop()
    return "\n".join(rows)


def read(text, raw):
    raw = raw.strip()
    if m := re.fullmatch(r".+?\s+(?:p\.|page\s+)(\d+)", raw, re.I):
        here, on = [], False
        found = False
        for line in text.splitlines():
            if mark := re.match(r"\s*<!--\s*page\s*:\s*(\d+)\s*-->\s*$", line, re.I):
                on = int(mark[1]) == int(m[1])
                found |= on
            elif on:
                here.append(line)
        return normalized("\n".join(here)) if found else None
    if m := re.fullmatch(r".+?\s+lines?\s+(\d+)-(\d+)", raw, re.I):
        rows, a, b = text.splitlines(), int(m[1]), int(m[2])
        return normalized("\n".join(rows[a - 1 : b])) if 1 <= a <= b <= len(rows) else None
    if m := re.fullmatch(r".+?\.(?:json|ya?ml)#((?:/.*)?)", raw, re.I):
        try:
            node = json.loads(text)
            for step in m[1].split("/")[1:]:
                step = step.replace("~1", "/").replace("~0", "~")
                node = node[int(step)] if isinstance(node, list) else node[step]
        except (ValueError, LookupError):
            return None
        return json.dumps(node, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return None


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(DOCS, "source string, text string"), spark.createDataFrame(ASKED + ASKED[:5], "source string, raw string")


def test_equals_a_reader(frames):
    docs = dict(DOCS)
    got = {(r.source, r.raw): r for r in evidence.acquire_fragments(*frames).collect()}
    assert got.keys() == set(ASKED)
    for (source, raw), r in got.items():
        text = docs.get(source)
        want = None if text is None else read(text, raw)
        assert r.excerpt == want, (source, raw)
        assert r.precision == ("unresolved" if want is None else "exact")
        basis = text if want is None else want
        assert r.digest == (None if basis is None else hashlib.sha256(basis.encode()).hexdigest())
    assert got["g.md", "g.md page 1"].excerpt == "one\none and a half\nmore" and got["g.md", "g p.3"].excerpt == ""


def test_sections(frames):
    got = {r.raw: (r.precision, r.excerpt) for r in evidence.acquire_fragments(*frames, sections=True).where("kind = 'section'").collect()}
    assert got == {
        "section: Errors > Codes": ("section", "### Codes\nE1"), "section:Auth": ("unresolved", None), "section:API > Auth": ("section", "## Auth\nkeys"),
        "section:Codes>Errors": ("unresolved", None), "section:Other": ("section", normalized(GUIDE[GUIDE.index("# Other") :].replace("\x0b", "\n").replace(" ", "\n"))),
    }


def test_references(spark, frames):
    right = hashlib.sha256(b"E1").hexdigest()
    told = spark.createDataFrame([("g.md", "g lines 8-8", right), ("g.md", "g lines 4-4", right), ("g.md", "g lines 8-9", None), ("gone.md", "x p.1", right)], "source string, raw string, digest string")
    assert sorted((r.raw, r.reason) for r in evidence.refuted_references(told, frames[0]).collect()) == [("g lines 4-4", "digest_mismatch"), ("g lines 8-9", "digest_mismatch"), ("x p.1", "unresolved")]


def test_nothing(spark, frames):
    assert evidence.acquire_fragments(frames[0], frames[1].limit(0), True).count() == 0
    assert {r.precision for r in evidence.acquire_fragments(frames[0].limit(0), frames[1], True).collect()} == {"unresolved"}


def test_lines_travel_in_blocks(spark):
    n = 2 * evidence.BLOCK_LINES + 5
    body = [f"l{i}" if i % 9 else "" for i in range(1, n + 1)]
    docs = spark.createDataFrame([("d", "\n".join(body)), ("e", ""), ("f", None)], "source string, text string")
    spans = [(1, 1), (1, n), (evidence.BLOCK_LINES, evidence.BLOCK_LINES + 1), (evidence.BLOCK_LINES + 1, 2 * evidence.BLOCK_LINES), (n, n), (5, n + 1)]
    found = evidence.acquire_fragments(docs, spark.createDataFrame([("d", f"d lines {a}-{b}") for a, b in spans] + [("e", "e lines 1-1"), ("f", "f lines 1-1")], "source string, raw string"))
    got = {r.raw: r.excerpt for r in found.collect()}
    assert got == {f"d lines {a}-{b}": "\n".join(body[a - 1 : b]).strip("\n") if b <= n else None for a, b in spans} | {"e lines 1-1": None, "f lines 1-1": None}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") <= 1  # only the documents that pointers ask for
