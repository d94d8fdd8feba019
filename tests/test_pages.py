"""Web pages by hand: Markdown, metadata, navigation, corpus."""

from __future__ import annotations

import hashlib

from attestor.sources import html

PAGE = """<html><head><title>Title</title><style>p {}</style></head><body>
<nav><ul><li><a href="/a/">First</a><ul><li><a href="/b#part">Second</a></li><li><a href="https://other.org/x">Away</a></li></ul></li><li><a href="#">none</a></li></ul></nav>
<main><h1>Head</h1><p>One <a href="/l">link</a> and <b>bold</b></p><p>One <a href="/l">link</a> and <b>bold</b></p><ul><li>x</li><li>y</li></ul><pre><code>code
  line</code></pre><h2>Sub</h2><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><script>var no;</script></main></body></html>"""
PAGES = [("https://h.org/start", PAGE), ("https://h.org/a", "<body><p>Short</p></body>"), ("https://h.org/none", None), ("https://h.org/empty", "")]


def table(spark):
    return spark.createDataFrame(PAGES, "url string, html string")


def test_markdown(spark):
    got = {r.url: r.m for r in table(spark).select("url", html.page_markdown("html").alias("m")).collect()}
    text = got["https://h.org/start"]
    for part in ("# Head", "One [link](/l) and", "- x", "- y", "## Sub", "code\n  line"):
        assert part in text, text
    assert text.count("One [link](/l)") == 1 and "var no" not in text and "First" not in text and "Title" not in text
    assert got["https://h.org/a"] == "Short\n" and not got["https://h.org/none"] and not got["https://h.org/empty"]
    snaps = {r.url: r for r in html.snapshots(table(spark)).collect()}
    assert snaps["https://h.org/start"].markdown == text and snaps["https://h.org/start"].raw_sha256 == hashlib.sha256(PAGE.encode()).hexdigest()


def test_metadata(spark):
    got = {r.url: r.m for r in table(spark).select("url", html.page_metadata("html").alias("m")).collect()}
    m = got["https://h.org/start"]
    assert (m.title, m.headings, m.hrefs) == ("Head", ["Head", "Sub"], ["/l"])
    assert m.body_text.startswith("Head One link and bold") and "var no" not in m.body_text and m.body_text.endswith("k v 1 2")
    assert got["https://h.org/a"].title is None and got["https://h.org/a"].body_text == "Short" and got["https://h.org/none"].body_text == ""


def test_navigation_and_corpus(spark):
    nodes = html.catalog(table(spark))
    got = {(r.node_url, r.anchor): (r.url, r.title, r.breadcrumb, r.parent_href) for r in nodes.collect()}
    assert got == {("https://h.org/a", None): ("https://h.org/start", "First", [], None), ("https://h.org/b", "part"): ("https://h.org/start", "Second", ["First"], "/a/")}
    cards = {r.node_url: r for r in html.corpus(nodes, table(spark).withColumnRenamed("url", "node_url")).collect()}
    assert {u: (c.status, c.title, c.body_characters, c.nav_title) for u, c in cards.items()} == {"https://h.org/a": ("fetched", None, 5, "First"), "https://h.org/b": ("failed", None, None, "Second")}
