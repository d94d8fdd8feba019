"""Web pages: Markdown, table grids, metadata and navigation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without an end tag, those that are no content, and those that end a paragraph.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"aside", "footer", "nav", "script", "style", "template"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "body", "html", "figure", "dl", "dd", "dt", "blockquote"}
MAX_COLSPAN, MAX_ROWSPAN = 16, 64
#: Bytes of pages that are Python objects at once, and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 10


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self, skip: set[str] = frozenset()) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in skip]

    def text(self, skip: set[str] = frozenset()) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                stack += reversed(node.children)
        return " ".join(" ".join(out).split())

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]


#: A tag that begins ends what is open of the first kinds, up to an element of the second.
IMPLIED = {
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "li": ({"li"}, {"ul", "ol"}), "option": ({"option"}, {"select"}),
    **{tag: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for tag in ("thead", "tbody", "tfoot")},
}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ended, held = IMPLIED.get(tag, ((), ()))
        cut = len(self.open)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in held:
                break
            if self.open[i].tag in ended:
                cut = i
        del self.open[cut:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def content_root(root: Node) -> Node:
    """The first main, else article, else body, else everything."""
    for tag in ("main", "article", "body"):
        if found := root.find(tag):
            return found[0]
    return root


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1")
    return int(value) if value.isdigit() and 1 <= int(value) <= most else 1


def _rows(table: Node) -> list[list[Node]]:
    """Cells by row of a table itself, not of tables inside its cells: its head, its bodies in order, its foot."""
    parts: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
    stack = [(node, "tbody") for node in reversed(table.children)]
    while stack:
        node, part = stack.pop()
        if isinstance(node, str):
            continue
        if node.tag == "tr":
            parts[part].append([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")])
        elif node.tag in parts:
            stack += [(child, node.tag) for child in reversed(node.children)]
    return parts["thead"] + parts["tbody"] + parts["tfoot"]


def table_grid(table: Node) -> list[list[str]]:
    """Cells on their places: a column span leaves blanks, a row span repeats downwards; overlapping spans give no table."""
    grid: dict[tuple[int, int], str] = {}
    for r, cells in enumerate(_rows(table)):
        c = 0
        for cell in cells:
            while (r, c) in grid:
                c += 1
            wide, tall, value = _span(cell, "colspan", MAX_COLSPAN), _span(cell, "rowspan", MAX_ROWSPAN), cell.text(DROPPED | {"table"})
            for i in range(tall):
                for j in range(wide):
                    if (r + i, c + j) in grid:
                        return []
                    grid[r + i, c + j] = value if j == 0 else ""
            c += wide
    if not grid:
        return []
    height, width = len(_rows(table)), 1 + max(c for _, c in grid)
    return [[grid.get((r, c), "") for c in range(width)] for r in range(height)]


def _inline(node) -> str:
    if isinstance(node, str):
        return node
    if node.tag in DROPPED:
        return ""
    inner = "".join(map(_inline, node.children))
    if node.tag == "br":
        return "\n"
    if node.tag == "a" and node.attrs.get("href"):
        return f"[{' '.join(inner.split())}]({node.attrs['href']})"
    if node.tag == "code":
        return f"`{inner}`"
    return inner


def _list(node: Node, depth: int) -> list[str]:
    out, n = [], 0
    for item in node.children:
        if not isinstance(item, Node) or item.tag != "li":
            continue
        n += 1
        own = "".join(_inline(c) for c in item.children if not (isinstance(c, Node) and c.tag in ("ul", "ol")))
        out.append("  " * depth + (f"{n}. " if node.tag == "ol" else "- ") + " ".join(own.split()))
        for c in item.children:
            if isinstance(c, Node) and c.tag in ("ul", "ol"):
                out += _list(c, depth + 1)
    return out


def _blocks(node: Node) -> Iterator[tuple[str, str]]:
    held = []

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            yield "p", text

    for child in node.children:
        if isinstance(child, str):
            held.append(child)
            continue
        tag = child.tag
        if tag in DROPPED:
            continue
        if re.fullmatch("h[1-6]", tag):
            yield from flush()
            if text := " ".join(_inline(child).split()):
                yield "h", "#" * int(tag[1]) + " " + text
        elif tag in ("ul", "ol"):
            yield from flush()
            if items := _list(child, 0):
                yield "list", "\n".join(items)
        elif tag == "pre":
            yield from flush()
            yield "pre", "```\n" + "".join(c if isinstance(c, str) else "".join(x for n in c.walk() for x in n.children if isinstance(x, str)) for c in child.children).strip("\n") + "\n```"
        elif tag == "table":
            yield from flush()
            if grid := table_grid(child):
                lines = ["| " + " | ".join(x.replace("|", "\\|") for x in row) + " |" for row in grid]
                yield "table", "\n".join([lines[0], "|" + " --- |" * len(grid[0]), *lines[1:]])
            for inner in child.find("table")[1:]:
                yield from _blocks(_wrap(inner))
        elif tag in BLOCKS:
            yield from flush()
            yield from _blocks(child)
        else:
            held.append(_inline(child))
    yield from flush()


def _wrap(node: Node) -> Node:
    box = Node("div")
    box.children.append(node)
    return box


def to_markdown(html: str | None) -> str:
    """Headings, paragraphs, lists, fences, links and tables of a page's content; a block that repeats stays once, lists apart."""
    seen, out = set(), []
    for kind, block in _blocks(content_root(parse(html))):
        if kind != "list" and block in seen:
            continue
        seen.add(block)
        out.append(block)
    return "\n\n".join(out) + ("\n" if out else "")


def each_page(pages: pa.Array, make: Callable, kind: pa.DataType) -> pa.Array:
    """``make`` of every page of a batch; a batch stays in Arrow's memory, and pages become Python objects a slice at a time."""
    sizes = pc.fill_null(pc.binary_length(pages), 0).to_pylist()
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > SLICE_BYTES or i - start == SLICE_ROWS):
            out.append(pa.array([make(p.as_py()) for p in pages.slice(start, i - start)], kind))
            start, held = i, 0
        held += n
    out.append(pa.array([make(p.as_py()) for p in pages.slice(start)], kind))
    return pa.concat_arrays(out)


@F.arrow_udf(T.StringType())
def page_markdown(html: pa.Array) -> pa.Array:
    return each_page(html, to_markdown, pa.string())


META = T.StructType([T.StructField("title", T.StringType()), T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("body_text", T.StringType()), T.StructField("hrefs", T.ArrayType(T.StringType()))])
_META = pa.struct([("title", pa.string()), ("headings", pa.list_(pa.string())), ("body_text", pa.string()), ("hrefs", pa.list_(pa.string()))])


@F.arrow_udf(META)
def page_metadata(html: pa.Array) -> pa.Array:
    """Title (first h1 of the content, else the title element), headings to level 4, body text and links in order."""

    def one(page):
        root = parse(page)
        body = content_root(root)
        heads = [t for n in body.find("h1", "h2", "h3", "h4") if (t := n.text(DROPPED))]
        h1 = [t for n in body.find("h1") if (t := n.text(DROPPED))]
        title = [t for n in root.find("title") if (t := n.text())]
        links = dict.fromkeys(n.attrs["href"] for n in body.walk(DROPPED) if n.tag == "a" and n.attrs.get("href"))
        return (h1 or title or [None])[0], heads, body.text(DROPPED), list(links)

    return each_page(html, one, _META)


GRID = T.ArrayType(T.StructType([T.StructField("table", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("text", T.StringType())]))


_GRID = pa.list_(pa.struct([("table", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())]))


@F.arrow_udf(GRID)
def table_cells(html: pa.Array) -> pa.Array:
    """Every cell of every table on its place."""

    def one(page):
        tables = content_root(parse(page)).find("table")
        return [(t, r, c, x) for t, node in enumerate(tables) for r, row in enumerate(table_grid(node)) for c, x in enumerate(row)]

    return each_page(html, one, _GRID)


NAV = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("title", T.StringType()), T.StructField("breadcrumb", T.ArrayType(T.StringType())), T.StructField("parent_href", T.StringType())]))


_NAV = pa.list_(pa.struct([("ordinal", pa.int32()), ("href", pa.string()), ("title", pa.string()), ("breadcrumb", pa.list_(pa.string())), ("parent_href", pa.string())]))


@F.arrow_udf(NAV)
def navigation(html: pa.Array) -> pa.Array:
    """Links of navigation lists with the titles and the link above them; anchors that are no pages are left out."""

    def one(page):
        out = []

        def visit(node: Node, crumbs: list[str], parent: str | None):
            for child in node.children:
                if not isinstance(child, Node):
                    continue
                if child.tag == "li":
                    link = next((n for n in child.walk({"ul", "ol"}) if n.tag == "a" and n.attrs.get("href")), None)
                    label = link.text() if link else child.text({"ul", "ol"})
                    here, href = [*crumbs, label] if label else crumbs, parent
                    if link and link.attrs["href"] != "#" and label:
                        href = link.attrs["href"]
                        out.append((len(out), href, label, crumbs, parent))
                    for inner in child.children:
                        if isinstance(inner, Node) and inner.tag in ("ul", "ol"):
                            visit(inner, here, href)
                else:
                    visit(child, crumbs, parent)

        for nav in parse(page).find("nav", "aside"):
            visit(nav, [], None)
        return out

    return each_page(html, one, _NAV)


def catalog(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, node_url, anchor, title, breadcrumb, parent_href) of every page's navigation on its own origin, each node once."""
    from attestor.functions.urls import same_origin_url

    nodes = pages.select(F.col(url).alias("url"), F.explode(navigation(F.col(html))).alias("n")).select("url", "n.*")
    nodes = nodes.withColumns({"node_url": same_origin_url(F.col("url"), F.col("href")), "anchor": F.nullif(F.regexp_extract("href", "#(.*)$", 1), F.lit(""))})
    first = nodes.where("node_url is not null").groupBy("url", "node_url", "anchor").agg(F.min(F.struct("ordinal", "title", "breadcrumb", "parent_href")).alias("n"))
    return first.select("url", "node_url", "anchor", "n.ordinal", "n.title", "n.breadcrumb", "n.parent_href")


def corpus(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages once each with the anchors that lead into them and their metadata; nodes without a page say so."""
    from attestor.functions.text import spa_shell

    per = nodes.groupBy("node_url").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"), F.min("title").alias("nav_title"))
    cards = pages.select("node_url", "html").withColumn("m", page_metadata("html")).select("node_url", F.sha2("html", 256).alias("content_sha256"), F.octet_length("html").alias("byte_size"), "m.title", "m.headings", F.length("m.body_text").alias("body_characters"), spa_shell(F.col("html"), F.col("m.body_text")).alias("spa_shell"))
    return per.join(cards, "node_url", "left").withColumn("status", F.when(F.col("content_sha256").isNull(), "failed").otherwise("fetched"))


def document_title(markdown):
    """The first level-1 heading of a Markdown document."""
    return F.nullif(F.trim(F.regexp_extract(markdown, r"(?m)^#\s+(.*)$", 1)), F.lit(""))


def llms_index(entries: DataFrame, entry_url: str = "entry_url", text: str = "text") -> DataFrame:
    """(entry_url, ordinal, label, url, accepted, reason) of an index's links (S16): same origin, Markdown, safe path, once each."""
    from attestor.functions.urls import origin

    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\[([^\]]*)\]\(([^)\s]+)\)"), F.lit(0))).alias("ordinal", "link")
    links = entries.select(F.col(entry_url).alias("entry_url"), found)
    links = links.select("entry_url", "ordinal", F.regexp_extract("link", r"\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("link", r"\(([^)\s]+)\)", 1).alias("url"))
    path = F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1)
    reason = F.when(origin(F.col("url")) != origin(F.col("entry_url")), "origin").when(~path.endswith(".md"), "not_markdown").when(path.rlike(r"(^|/)\.\.?(/|$)|%2[eEfF]|\\"), "unsafe_path")
    links = links.withColumn("reason", reason)
    first = links.where("reason is null").groupBy("entry_url", "url").agg(F.min("ordinal").alias("first"))
    met = links.join(first, ["entry_url", "url"], "left")
    met = met.withColumn("reason", F.coalesce("reason", F.when(F.col("ordinal") != F.col("first"), "duplicate")))
    return met.select("entry_url", "ordinal", "label", "url", F.col("reason").isNull().alias("accepted"), "reason")


def snapshots(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, markdown, raw_sha256) ready to be written."""
    return pages.select(F.col(url).alias("url"), page_markdown(F.col(html)).alias("markdown"), F.sha2(html, 256).alias("raw_sha256"))
