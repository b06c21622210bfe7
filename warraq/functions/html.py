"""Main text of a web page, by the standard library's parser (markup needs a state machine, so this one runs in Python, in Arrow batches)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags without text of their own, terms of class and id that mark noise, and where the main text is looked for.
DROPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "button", "iframe", "figure", "noscript"}
NOISE = ["sidebar", "menu", "footer", "header", "nav", "widget", "related", "social", "trending", "comments", "tags", "tag", "topic", "theme", "category", "breadcrumb", "banner", "popular", "toolbar", "sharing", "b-menu", "b-header", "b-footer", "b-sidebar", "b-nav", "ad-", "popup"]
SELECTORS = [(None, "article__text"), (None, "b-article__text"), ("div", "article-text"), (None, "wysiwyg--all-content"), ("div", "wysiwyg"), ("article", "article-body"), ("div", "article-content"), ("div", "article-body"), ("article", None), ("main", None)]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NOISE = re.compile("|".join(map(re.escape, NOISE)), re.I)
_CLOSES_P = {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "blockquote", "main", "body"}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []  # type: ignore[var-annotated]

    def noisy(self) -> bool:
        return self.tag in DROPPED or any(_NOISE.search(c) for c in self.attrs.get("class", "").split()) or bool(_NOISE.search(self.attrs.get("id", "")))

    def texts(self) -> list[str]:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(n.strip())
            else:
                stack.extend(reversed(n.children))
        return out

    def walk(self):  # noqa: ANN201
        stack: list[Node] = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES_P and self.here.tag == "p":
            self.here = self.here.parent or self.root
        n = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(n)
        if tag not in _VOID:
            self.here = n

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.here
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.here = n.parent

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)


def _without_noise(n: Node) -> None:
    stack = [n]
    while stack:
        m = stack.pop()
        m.children = [c for c in m.children if not (isinstance(c, Node) and c.noisy())]
        stack.extend(c for c in m.children if isinstance(c, Node))


def main_text(html: str | None) -> str | None:
    """Paragraphs of the main container longer than 35 characters if over 150 in all, else all its text if over 150, else None."""
    if not html:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    _without_noise(root)
    nodes = list(root.walk())
    main = None
    for tag, cls in SELECTORS:
        hit = next((n for n in nodes if n.tag and (tag is None or n.tag == tag) and (cls is None or cls in n.attrs.get("class", "").split())), None)
        if hit is not None and len("".join(hit.texts())) > 200:
            main = hit
            break
    main = main or next((n for n in nodes if n.tag == "body"), root)
    blocks = [" ".join(n.texts()) for n in main.walk() if n.tag == "p"]
    for text in (" ".join(b for b in blocks if len(b) > 35), " ".join(main.texts())):
        if len(text) > 150:
            return re.sub(r"\s+", " ", text).strip()
    return None


@F.pandas_udf(T.StringType())
def _main_text_udf(s: pd.Series) -> pd.Series:
    return s.map(main_text, na_action="ignore")


def main_text_column(c: Column) -> Column:
    return _main_text_udf(c)
