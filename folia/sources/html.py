"""Web pages as flat element tables: pre-order numbers with the last number of each subtree."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from folia.sources.by_row import by_row

# HTML's void elements and implied ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

SCHEMA = "page_id long, pre int, last_pre int, parent int, depth int, kind string, tag string, attrs map<string,string>, text string"


#: Scripts and styles, whose text holds no references, or an ampersand with what may be a reference's name.
_REFERENCES = re.compile(r"<(script|style)\b.*?(?:</\1|\Z)|&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", re.S | re.I)


def closed_references(html: str) -> str:
    """The page with those ampersands written out that no known reference with its semicolon follows: '&amp' at the end
    of a cut text stays as it is written."""
    keep = lambda m: m[1] or (m[2] and (m[2][0] == "#" or m[2] in html5))
    return _REFERENCES.sub(lambda m: m[0] if keep(m) else "&amp;" + m[0][1:], html)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, kind, tag, attrs, text) -> int:
        k = len(self.rows)
        self.rows.append([k, k, self.open[-1] if self.open else -1, len(self.open), kind, tag, attrs, text])
        return k

    def _close(self) -> None:
        self.rows[self.open.pop()][1] = len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag, {"p"} if tag in ENDS_P else set())
        while self.open and self.rows[self.open[-1]][5] in ends:
            self._close()
        k = self._add("element", tag, {a: v or "" for a, v in attrs}, None)
        if tag not in VOID:
            self.open.append(k)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag):
        if any(self.rows[k][5] == tag for k in self.open):
            while self.rows[self.open[-1]][5] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.rows and self.rows[-1][4] == "text" and self.rows[-1][2] == (self.open[-1] if self.open else -1):
            self.rows[-1][7] += data
        else:
            self._add("text", None, None, data)


def tree(html: str | None, closed: bool = False) -> list[list]:
    """The rows of a page. References without a semicolon are read as browsers do, or, if closed, not at all."""
    t = _Tree()
    t.feed(closed_references(html or "") if closed else html or "")
    t.close()
    while t.open:
        t._close()
    return t.rows


def dom_nodes(pages: DataFrame, closed: bool = False) -> DataFrame:
    """A row per element and text node of every page; closed as in `tree`."""

    def nodes(page_id, html):
        for *place, attrs, text in tree(html, closed):
            yield (page_id, *place, None if attrs is None else list(attrs.items()), text)

    return by_row(pages.select("page_id", "html"), nodes, SCHEMA)
