"""Extraction from stored HTML.

One Arrow UDF turns a page into its text nodes and the elements asked for; each element knows which
slice of the text nodes it spans. Everything else (texts, selectors, links, blocks) is a native
expression over that struct, so one parse per page serves all operators of a query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import absolutize_url, collapse_blank_lines, join_parts, strip, truncate_preview, resolve_url
from siftwell.operators.ranking import longest_first

# Elements without content, and elements whose text is not visible.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style template rt rp".split())

HEADING_TAGS = ("h1", "h2", "h3", "h4")
BLOCK_TAGS = ("section", "article", "div")
CARD_TAGS = ("article", "li", "div")
JSON_LD_TYPE = "application/ld+json"

DOM_TYPE = (
    "struct<texts: array<string>, nodes: array<struct<"
    "tag: string, attrs: map<string, string>, card: int, first: int, last: int, "
    "raw: string, outer: string>>, error: string>"
)
_ARROW_NODE = pa.struct(
    {
        "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "card": pa.int32(),
        "first": pa.int32(), "last": pa.int32(), "raw": pa.string(), "outer": pa.string(),
    }
)
_ARROW_DOM = pa.struct({"texts": pa.list_(pa.string()), "nodes": pa.list_(_ARROW_NODE), "error": pa.string()})


class _Dom(HTMLParser):
    """Collects the text nodes and the wanted elements of one page.

    An end tag closes everything opened since its start tag, and is ignored without one.
    """

    def __init__(self, tags, attrs, outer_size):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.outer_size = tags, attrs, outer_size
        self.texts, self.nodes, self.pending = [], [], []
        self.stack = []  # (tag, node or None, card position, source offset)
        self.open = Counter()

    def parse(self, html):
        self.html = html
        self.line_starts = [0] + [m.end() for m in re.finditer("\n", html)]
        self.feed(html)
        self.close()
        self.flush()
        while self.stack:
            self.pop(len(html))
        return {"texts": self.texts, "nodes": self.nodes, "error": None}

    def position(self):
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def flush(self):
        if not self.pending:
            return
        text, self.pending = "".join(self.pending), []
        if any(self.open[t] for t in HIDDEN_TAGS):
            node = self.stack[-1][1]
            if node is not None:
                node["raw"] = (node["raw"] or "") + text
        elif text.strip(" \t\n\x0c\r"):
            self.texts.append(text)
        else:
            self.texts.append("\n" if "\n" in text else " ")

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_starttag(self, tag, attrs, closed=False):
        self.flush()
        attributes = {name: value or "" for name, value in attrs}
        card = self.stack[-1][2] if self.stack else -1
        node = None
        if tag in self.tags or not self.attrs.isdisjoint(attributes):
            node = {"tag": tag, "attrs": list(attributes.items()), "card": card, "first": len(self.texts), "raw": None}
            self.nodes.append(node)
            if tag in CARD_TAGS:
                card = len(self.nodes) - 1
        self.stack.append((tag, node, card, self.position()))
        self.open[tag] += 1
        if closed or tag in VOID_TAGS:
            self.pop(self.position() + len(self.get_starttag_text()))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag):
        self.flush()
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop(self.position())
            self.pop(self.html.find(">", self.position()) + 1 or len(self.html))

    def pop(self, end):
        tag, node, _, start = self.stack.pop()
        self.open[tag] -= 1
        if node is not None:
            node["last"] = len(self.texts)
            node["outer"] = self.html[start : min(end, start + self.outer_size)]


def parse_html(
    html: Column, tags: Sequence[str] = (), attrs: Sequence[str] = (), outer_size: int = 0
) -> Column:
    """Struct of a page's text nodes and of its elements in document order.

    Elements are kept when their tag is in ``tags`` or they carry one of ``attrs``. ``outer`` holds
    the first ``outer_size`` characters of an element's source. ``card`` is the position of the
    nearest kept article, li or div around the element, or -1. A page that cannot be parsed yields
    empty arrays and an ``error``.
    """
    wanted_tags, wanted_attrs = frozenset(tags), frozenset(attrs)

    def parse_one(page):
        try:
            if page is None:
                raise ValueError("no page stored")
            return _Dom(wanted_tags, wanted_attrs, outer_size).parse(page)
        except Exception as error:
            return {"texts": [], "nodes": [], "error": str(error)}

    @F.arrow_udf(DOM_TYPE)
    def parse(pages: pa.Array) -> pa.Array:
        return pa.array([parse_one(page) for page in pages.to_pylist()], type=_ARROW_DOM)

    return parse(html)


def all_text(dom: Column, separator: str | None = None) -> Column:
    return _joined(dom["texts"], separator)


def node_text(dom: Column, node: Column, separator: str | None = None) -> Column:
    """Text of an element: stripped parts joined by ``separator``, or the plain text for None."""
    span = F.slice(dom["texts"], node["first"] + 1, node["last"] - node["first"])
    return _joined(span, separator)


def _joined(texts: Column, separator: str | None) -> Column:
    if separator is None:
        return F.array_join(texts, "")
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), separator)


def nodes_of(dom: Column, *tags: str) -> Column:
    return F.filter(dom["nodes"], lambda n: n["tag"].isin(*tags))


def attribute(node: Column, name: str) -> Column:
    return F.coalesce(F.element_at(node["attrs"], name), F.lit(""))


def class_name(node: Column) -> Column:
    """Class names joined by single blanks."""
    return strip(F.regexp_replace(attribute(node, "class"), r"\s+", " "))


def first_text(dom: Column, tag: str) -> Column:
    """Text of the first element of a tag, or the empty string."""
    node = F.get(nodes_of(dom, tag), 0)
    return F.when(node.isNotNull(), node_text(dom, node, "")).otherwise("")


def json_ld_documents(dom: Column) -> Column:
    """JSON-LD scripts of a page, each stripped, as an array."""
    scripts = F.filter(nodes_of(dom, "script"), lambda n: attribute(n, "type") == JSON_LD_TYPE)
    return F.transform(scripts, lambda n: strip(F.coalesce(n["raw"], F.lit(""))))


def json_ld_text(dom: Column) -> Column:
    return strip(F.array_join(json_ld_documents(dom), "\n"))


def body_text(dom: Column, separator: str | None = "\n") -> Column:
    """Visible text of the body, or of the whole page where it has none."""
    body = F.get(nodes_of(dom, "body"), 0)
    return F.when(body.isNotNull(), node_text(dom, body, separator)).otherwise(all_text(dom, separator))


# Where the structured parts of a posting are found.
SECTION_SELECTORS = (
    "[data-sentry-component='RecruitmentGuidelines']",
    "[data-sentry-component='Qualification']",
    "#application-section",
    "#company-section",
    "[data-sentry-component='BenefitCard']",
)


def split_selector(selector: str) -> tuple[str, str, str | None]:
    """(kind, name, value) of a selector: a tag, ``#id``, ``.class``, ``[attr='value']``, or ``[attr]`` for any value."""
    if selector.startswith("#"):
        return "attr", "id", selector[1:]
    if selector.startswith("."):
        return "class", "class", selector[1:]
    if selector.startswith("["):
        name, equals, value = selector.strip("[]").partition("=")
        return "attr", name, value.strip("'\"") if equals else None
    return "tag", selector, None


def _matcher(selector: str):
    kind, name, value = split_selector(selector)

    def matches(node: Column) -> Column:
        if kind == "tag":
            return node["tag"] == name
        if kind == "class":
            return F.array_contains(F.split(class_name(node), " "), value)
        if value is None:
            return F.element_at(node["attrs"], name).isNotNull()
        return F.element_at(node["attrs"], name).eqNullSafe(F.lit(value))

    return matches


def section_text(dom: Column, selectors: Sequence[str] = SECTION_SELECTORS) -> Column:
    """Text of the first match of each selector, joined by a blank line; missing ones are skipped."""
    parts = []
    for selector in selectors:
        node = F.get(F.filter(dom["nodes"], _matcher(selector)), 0)
        parts.append(F.when(node.isNotNull(), node_text(dom, node, "\n")))
    return join_parts(F.array(*parts), "\n\n")


def selector_needs(selectors: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The ``tags`` and ``attrs`` arguments of ``parse_html`` that a list of selectors needs."""
    split = [split_selector(s) for s in selectors]
    return {
        "tags": tuple(name for kind, name, _ in split if kind == "tag"),
        "attrs": tuple(name for kind, name, _ in split if kind != "tag"),
    }


def headings(dom: Column) -> Column:
    """Array of non-empty headings: tag in upper case, text, class."""
    found = F.transform(
        nodes_of(dom, *HEADING_TAGS),
        lambda n: F.struct(
            F.upper(n["tag"]).alias("tag"), node_text(dom, n, "").alias("text"), class_name(n).alias("className")
        ),
    )
    return F.filter(found, lambda h: h["text"] != "")


def links(dom: Column) -> Column:
    """Array of anchors that have a text or an address."""
    found = F.transform(
        nodes_of(dom, "a"),
        lambda n: F.struct(
            node_text(dom, n, "").alias("text"), attribute(n, "href").alias("href"), class_name(n).alias("className")
        ),
    )
    return F.filter(found, lambda a: (a["text"] != "") | (a["href"] != ""))


def long_blocks(blocks: Column, minimum: int = 300) -> Column:
    """Blocks whose text is longer than ``minimum``."""
    return F.filter(blocks, lambda b: b["textLength"] > minimum)


def text_blocks(dom: Column, minimum: int = 300, top: int = 30) -> Column:
    """The longest section, article and div elements of a page, longest first.

    Parse with ``outer_size=1500``: the source preview comes from there.
    """
    texts = F.transform(
        nodes_of(dom, *BLOCK_TAGS),
        lambda n, i: F.struct(i.cast("int").alias("index"), n.alias("node"), node_text(dom, n, " ").alias("text")),
    )
    blocks = F.transform(
        texts,
        lambda t: F.struct(
            t["index"].alias("index"),
            F.upper(t["node"]["tag"]).alias("tag"),
            class_name(t["node"]).alias("className"),
            attribute(t["node"], "id").alias("id"),
            F.length(t["text"]).alias("textLength"),
            truncate_preview(t["text"], 1000).alias("textPreview"),
            truncate_preview(t["node"]["outer"], 1500).alias("outerHTMLPreview"),
        ),
    )
    return longest_first(long_blocks(blocks, minimum), "textLength", "index", top)


def title_links(dom: Column, host: str, path: str, marker: tuple[str, str] | None) -> Column:
    """Anchors whose address holds ``path``, with the text of the card around them.

    ``marker`` is an (attribute, value) pair the anchor has to carry, or None. The order of events:
    the path is tested on the stored address, which is then made absolute.
    """

    def wanted(n: Column) -> Column:
        hit = attribute(n, "href").contains(path)
        if marker:
            hit = hit & F.element_at(n["attrs"], marker[0]).eqNullSafe(F.lit(marker[1]))
        return hit

    def card_text(n: Column) -> Column:
        card = F.get(dom["nodes"], n["card"])
        return F.when(n["card"] >= 0, truncate_preview(node_text(dom, card, " "), 500)).otherwise("")

    return F.transform(
        F.filter(nodes_of(dom, "a"), wanted),
        lambda n: F.struct(
            node_text(dom, n, "").alias("text"),
            absolutize_url(attribute(n, "href"), host).alias("href"),
            class_name(n).alias("className"),
            card_text(n).alias("parentText"),
            n["outer"].alias("outerHTML"),
        ),
    )


# Fixed value: the title of the frame that holds the details of a posting.
DETAIL_FRAME = "상세 모집 요강"


def frame_address(dom: Column, url: Column, title: str = DETAIL_FRAME) -> Column:
    """Address of the first frame with a title, resolved against that of its page; null without frame or address.

    Parse with ``tags=["iframe"]`` and ``attrs=["title", "src"]``.
    """
    frame = F.get(F.filter(nodes_of(dom, "iframe"), lambda n: attribute(n, "title") == title), 0)
    source = F.nullif(attribute(frame, "src"), F.lit(""))
    return F.when(source.isNotNull(), resolve_url(url, source))


WHOLE_SOURCE = 2**31 - 1


def extract_or_quarantine(
    pages: DataFrame,
    html: str = "html",
    url: str = "url",
    frame_html: str | None = None,
    company_tag: str = "h2",
    selectors: Sequence[str] = SECTION_SELECTORS,
) -> DataFrame:
    """One raw posting per page, whatever the page holds.

    A page that cannot be parsed becomes a row with blank fields, status ``fail`` and the message.
    The body comes from ``frame_html`` where given, else from the page itself.
    """
    needs = selector_needs(selectors)
    tags = {"body", "script", company_tag, *needs["tags"]}
    parsed = pages.withColumn("_dom", parse_html(F.col(html), sorted(tags), needs["attrs"]))
    parsed = parsed.withColumn("_frame", parse_html(F.col(frame_html), ["body"]) if frame_html else F.col("_dom"))
    dom, frame = F.col("_dom"), F.col("_frame")
    ok = dom["error"].isNull()

    def field(value: Column) -> Column:
        return F.when(ok, value).otherwise("")

    frame_text = F.when(frame["error"].isNull(), body_text(frame, "\n")).otherwise("")
    return parsed.select(
        *[c for c in pages.columns if c not in (html, url, frame_html)],
        field(first_text(dom, company_tag)).alias("company"),
        F.col(url).alias("url"),
        field(collapse_blank_lines(frame_text)).alias("iframe_jd_text"),
        field(collapse_blank_lines(section_text(dom, selectors))).alias("main_jd_text"),
        field(json_ld_text(dom)).alias("json_ld"),
        F.when(ok, "success").otherwise("fail").alias("status"),
        F.coalesce(dom["error"], F.lit("")).alias("error"),
    )
