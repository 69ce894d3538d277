"""What a page's article is about, from JSON-LD at any depth and from the page's elements. Pages go to Python workers
in Arrow batches, one at a time; a page's tree is all that is held."""

from __future__ import annotations

import html as entities
import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements and names that are no part of an article; where its text is looked for, in this order; elements
# that are its blocks; letters from which a text is taken without looking further.
NO_TEXT = ("script", "style", "noscript", "template", "svg")
NO_ARTICLE = (
    "nav", "header", "footer", "aside", "dialog", "[hidden]", '[aria-hidden="true"]', ".usa-banner", ".usa-breadcrumb", ".breadcrumb", ".breadcrumbs",
    ".site-header", ".site-footer", ".navigation", ".pagination", ".social-share", ".share-buttons", ".related-content", ".cookie-banner", ".feedback",
    ".subscribe", '[class*="official-website"]', '[id*="official-website"]',
)
NO_PART = (
    "nav", "header", "footer", "aside", "form", ".usa-banner", ".breadcrumb", ".breadcrumbs", ".social-share", ".share-buttons", ".related-content",
    ".pagination", ".feedback", ".subscribe",
)
PLACES = (
    '[itemprop="articleBody"]', ".field--name-field-press-body", '[itemprop="text"]', ".ms-rtestate-field", ".field--name-body", ".article-body",
    ".article__body", ".news-release-body", "main article", "article", 'main [role="main"]', "main", '[role="main"]', "#content", "body",
)
BLOCKS = ("p", "li", "h2", "h3", "h4", "blockquote", "pre", "tr")
ENOUGH = 80
#: Types of articles; the fields of their dates.
TYPES = ("NewsArticle", "Article", "Report")
DATE_FIELDS = ("datePublished", "datePosted", "dateCreated")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HEAD = ("head", "title")
_SIBLINGS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self, without=lambda node: False):
        """The nodes below in document order, but for those that are left out with all they hold."""
        stack = [self]
        while stack:
            node = stack.pop()
            if node is not self:
                yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node) and not without(c)]

    def text(self, without=lambda node: False) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += [c for c in reversed(x.children) if isinstance(c, str) or not without(c)]
        return "".join(out)


class _Tree(HTMLParser):
    """A tree of a page; end tags that are left out are supplied where a paragraph, item, row or cell must end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._end(("p",), ("table", "td", "li"))
        elif tag in _SIBLINGS:
            self._end(_SIBLINGS[tag], ("table", "ul", "ol", "select"))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def _end(self, tags: tuple, within: tuple) -> None:
        node = self.at
        while node.parent is not None and node.tag not in within:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _test(part: str):
    """A test of one node for a simple selector: a name, .class, #id, [attribute], [attribute="value"] or [attribute*="part"]."""
    if part[0] == ".":
        return lambda n: part[1:] in n.attrs.get("class", "").split()
    if part[0] == "#":
        return lambda n: n.attrs.get("id") == part[1:]
    if part[0] == "[":
        name, value = (part[1:-1].split("=", 1) + [None])[:2]
        if value is None:
            return lambda n: name in n.attrs
        value = value.strip('"')
        if name[-1] == "*":
            return lambda n: value in n.attrs.get(name[:-1], "")
        return lambda n: n.attrs.get(name) == value
    return lambda n: n.tag == part


def _selector(text: str):
    """A test of a node for simple selectors of it and of ancestors in order."""
    *above, own = map(_test, text.split(" "))

    def fits(node: Node) -> bool:
        if not own(node):
            return False
        left = list(above)
        while left and (node := node.parent) is not None:
            if left[-1](node):
                left.pop()
        return not left

    return fits


def _any(selectors: tuple):
    tests = [_test(s) for s in selectors]
    return lambda node: any(t(node) for t in tests)


_LEFT_OUT, _NO_PART, _PLACES = _any(NO_TEXT + NO_ARTICLE), _any(NO_PART), [_selector(s) for s in PLACES]


def clean(value: str | None) -> str | None:
    """Text without tags, character references read, one space for each run of white space; null if nothing is left."""
    if value is None:
        return None
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", "", value)).split()) or None


def body_text(page: str | None) -> str | None:
    """The text of a page's article: of the first of PLACES that has ENOUGH letters, else of the first that has any. Of
    several elements there the longest; its outermost blocks, or all of it where it has none."""
    if not page:
        return None
    tree = _Tree()
    tree.feed(page)
    tree.close()
    nodes = list(tree.root.walk(_LEFT_OUT))
    if not any(n.tag == "body" for n in nodes):  # then all that isn't of the head is the body
        tree.root.tag = "body"
        nodes.insert(0, tree.root)
    short = None
    for fits in _PLACES:
        best = ""
        for node in nodes:
            if fits(node):
                without = lambda n: n.tag in _HEAD or _LEFT_OUT(n) or _NO_PART(n)
                blocks = [b for b in node.walk(without) if b.tag in BLOCKS and not _inside_block(b, node)]
                parts = [t for b in blocks if (t := clean(b.text(without)))]
                text = clean("\n".join(parts) if parts else node.text(without)) or ""
                best = max(best, text, key=len)
        if len(best) >= ENOUGH:
            return best
        short = short or best or None
    return short


def _inside_block(node: Node, container: Node) -> bool:
    while node is not container and (node := node.parent) is not None:
        if node.tag in BLOCKS:
            return True
        if node is container:
            return False
    return False


def article_object(value) -> dict | None:
    """The first object of an article's type in a JSON value, at any depth, itself before what it holds."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            kind = x.get("@type")
            if (isinstance(kind, str) and kind in TYPES) or (isinstance(kind, list) and "NewsArticle" in kind):
                return x
            stack += reversed(list(x.values()))
    return None


def first_string(value, names: tuple) -> str | None:
    """The first string under one of the names in a JSON value, at any depth."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            for name in names:
                if isinstance(x.get(name), str):
                    return x[name]
            stack += reversed(list(x.values()))
    return None


def json_article(blocks: list[str] | None) -> dict:
    """Headline, description, body and dates of the first article in a page's JSON-LD blocks; those that can't be read are
    passed over. any_date: the first date of a block up to that one."""
    found, any_date = None, None
    for block in blocks if blocks is not None else ():
        if found is not None:
            break
        try:
            value = json.loads(block)
        except (ValueError, RecursionError):
            continue
        found = article_object(value)
        any_date = any_date or first_string(value, DATE_FIELDS)
    pick = lambda name: found[name] if found and isinstance(found.get(name), str) else None
    return {"headline": pick("headline"), "description": pick("description"), "body": pick("articleBody"), "published": pick("datePublished"), "any_date": any_date}


def cleaned(value: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(clean, na_action="ignore"), "string")(value)


def body(page: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(body_text), "string")(page)


def resolved(href: Column, base: Column) -> Column:
    """An address as it stands in a page of an address; the page's own where there is none or it can't be read."""

    def join(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
        def one(h, b):
            try:
                return urljoin(b, h.strip()) if isinstance(h, str) and isinstance(b, str) else b
            except ValueError:
                return b

        return pd.Series([one(h, b) for h, b in zip(hrefs, bases, strict=True)], dtype=object)

    return F.pandas_udf(join, "string")(href, base)


def json_fields(blocks: Column) -> Column:
    """json_article() of an array of blocks, as a struct."""

    def read(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([json_article(b) for b in column], columns=["headline", "description", "body", "published", "any_date"], dtype=object)

    return F.pandas_udf(read, "headline string, description string, body string, published string, any_date string")(blocks)
