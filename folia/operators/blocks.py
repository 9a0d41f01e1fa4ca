"""Pages as block trees: typed blocks addressed by their path, with styled text spans.

`page_blocks` gives a row per block in reading order. A page is folded by itself; no exchange is needed. Rules that
shape the result: text between blocks becomes a paragraph unless blank; headings, paragraphs and captions stay even
when empty, other containers only with content; a block element inside inline content is left out with its text;
figures dissolve into images and captions. Text is in normal form C with runs of blanks as one space, except in
preformatted blocks. `deltas` leads from positions of the stored text back to the raw text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.operators.article import article
from folia.sources.by_row import by_row
from folia.sources.html import tree
from folia.sources.page_index import BLANK, BLANKS, PageIndex, units

# Block types, styles and pass-through elements.
TYPES = dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6"], "heading") | {
    "p": "paragraph", "blockquote": "blockquote", "pre": "preformatted", "table": "table", "tr": "tablerow", "td": "tablecell", "th": "tablecell",
    "ul": "list", "ol": "list", "li": "listitem", "img": "image", "figure": "figure", "figcaption": "caption",
}
STYLES = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "cite": "italic", "sup": "sup", "sub": "sub", "code": "monospace", "tt": "monospace", "kbd": "monospace", "samp": "monospace"}
PASS_THROUGH = {"div", "section", "article", "main", "header", "footer", "nav", "span", "small", "u", "mark", "abbr", "dfn", "var", "q", "ruby", "rt", "rp", "bdi", "bdo", "wbr", "time", "data"}
NOTE_TYPES = {"footnote", "rearnote", "note", "endnote"}
_ADDRESS = re.compile(r"(https?|file|data):", re.I)
_PICTURE = re.compile(r".*\.(png|jpe?g|gif|svg|webp|bmp|tiff?|avif)", re.I | re.S)

SPAN = "struct<text:string,styles:array<string>,url:string,stream:int,deltas:array<struct<at:int,delta:int>>>"
SCHEMA = f"page_id long, block_no int, ref array<int>, type string, tag string, pre int, level int, ordered boolean, start_index int, header boolean, colspan int, rowspan int, selector string, text string, spans array<{SPAN}>"


def book_type(attrs: dict) -> list[str]:
    return (attrs.get("epub:type") or attrs.get("type") or "").split()


def picture_text(attrs: dict) -> str:
    """The label of an image, else its alternative text unless that is a path."""
    label, alt = attrs.get("aria-label", "").strip(BLANK), attrs.get("alt", "").strip(BLANK)
    path = not BLANKS.search(alt) and (_ADDRESS.match(alt) or re.search(r"[\\/]", alt) or _PICTURE.fullmatch(alt))
    return label or ("" if path else alt)


def whole_number(value: str | None) -> int:
    m = re.match(rf"[{BLANK}]*([+-]?[0-9]+)", value or "")
    return int(m[1]) if m else 0


def squeeze(raw: str) -> tuple[str, list[tuple[int, int]]]:
    """Blanks collapsed, with the shifts (position, shift so far) in UTF-16 units."""
    shifts, done, shift, out = [], 0, 0, []
    for m in BLANKS.finditer(raw):
        out += [raw[done : m.start()], " "]
        done = m.end()
        if len(m[0]) > 1:
            shift -= len(m[0]) - 1
            shifts.append((units(raw[: m.end()]) + shift, shift))
    return "".join([*out, raw[done:]]), shifts


def composed(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Normal form C with its shifts. The text is cut where composition cannot reach across: before each character
    that is a starter and stays the first character of its own normal form after the run before it."""
    nfc = unicodedata.normalize("NFC", text)
    if nfc == text:
        return text, []
    shifts, shift, at, run = [], 0, 0, ""
    for c in [*text, None]:
        joined = c is not None and run and unicodedata.normalize("NFC", run + c) != unicodedata.normalize("NFC", run) + c
        if run and not joined:
            new = unicodedata.normalize("NFC", run)
            at += units(new)
            if units(new) != units(run):
                shift += units(new) - units(run)
                shifts.append((at, shift))
            run = ""
        run += c or ""
    return nfc, shifts


def chained(outer: list[tuple[int, int]], inner: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Shifts of inner's text changed again by outer, from the last text back to inner's source."""

    def back(shifts, x):
        i = bisect_right(shifts, x, key=lambda s: s[0])
        return x - (shifts[i - 1][1] if i else 0)

    # a place of inner's text stands in the last text where the shift in force there leads back to it
    turns = {at for at, _ in outer}
    for at, _ in inner:
        turns.update(x for x in {at + d for d in {0, *(d for _, d in outer)}} if back(outer, x) == at)
    out, last = [], 0
    for at in sorted(turns):
        d = at - back(inner, back(outer, at))
        if d != last:
            out.append((at, d))
            last = d
    return out


@dataclass
class Block:
    type: str
    node: int
    content: list = field(default_factory=list)  # blocks, or spans
    facts: dict = field(default_factory=dict)
    end: int | None = None  # the last node of a list's part that a note cuts off


@dataclass
class Span:
    text: str
    styles: tuple = ()
    url: str | None = None
    stream: int | None = None
    deltas: list = field(default_factory=list)


class Converter:
    def __init__(self, page: PageIndex, kept: set[int] | None = None, notes: bool = False):
        """notes: whether elements marked as notes become note blocks, as in books."""
        self.page, self.kept, self.notes = page, kept, notes
        self.seen: set[int] = set()  # elements that the conversion came to
        self.links: list[tuple[int, str]] = []  # those with a link inside the book
        self.stream, at, hidden = {}, 0, -1
        for k in range(0 if page.body is None else page.body, len(page.tag)):
            if page.tag[k] == "template":
                hidden = max(hidden, page.last[k])
            if page.tag[k] is None and k > hidden:
                self.stream[k] = at
                at += units(page.text[k])

    def included(self, k: int) -> bool:
        ok = self.page.tag[k] not in {"script", "style"} and (self.kept is None or k in self.kept)
        if ok:
            self.seen.add(k)
        return ok

    def is_note(self, k: int) -> bool:
        return self.notes and not NOTE_TYPES.isdisjoint(book_type(self.page.attrs[k]))

    def has_blocks(self, k: int) -> bool:
        p = self.page
        return any((t in TYPES and t != "img") or (t in PASS_THROUGH and self.has_blocks(c)) for c in p.kids[k] if (t := p.tag[c]))

    # blocks

    def blocks(self, k: int) -> list[Block]:
        return [b for c in self.page.kids[k] for b in self.node(c)]

    def node(self, k: int) -> Iterator[Block]:
        p, tag = self.page, self.page.tag[k]
        if tag is None:
            if p.text[k].strip(BLANK):
                yield Block("paragraph", k, [self.span(k, p.text[k], [], ())])
            return
        if not self.included(k):
            return
        if self.is_note(k):
            yield from self.filled("note", k)
            return
        kind = TYPES.get(tag)
        if kind in {"heading", "paragraph", "caption", "preformatted"}:
            yield Block(kind, k, self.inline(k, kind == "preformatted"), {"level": int(tag[1])} if kind == "heading" else {})
        elif kind == "image":
            label = picture_text(p.attrs[k])
            yield Block("image", k, [Span(label)] if label else [])
        elif kind == "listitem":
            yield from (Block("list", k, [item]) for item in self.filled("listitem", k))
        elif kind == "list":
            yield from self.listing(k, tag)
        elif kind == "table":
            rows = list(self.lines(k))
            if rows or (rows := self.inline(k)):
                yield Block("table", k, rows)
        elif kind == "blockquote":
            if inner := self.blocks(k):
                yield Block("blockquote", k, inner)
        elif kind == "figure":
            for c in p.elements_in(k):
                yield from self.node(c)
        elif kind or self.has_blocks(k):
            yield from self.blocks(k)
        elif spans := self.inline(k):
            yield Block("paragraph", k, spans)

    def filled(self, kind: str, k: int) -> Iterator[Block]:
        """A container of blocks or of text; none if empty."""
        content = self.blocks(k) if self.has_blocks(k) else self.inline(k)
        if content:
            yield Block(kind, k, content)

    def listing(self, k: int, tag: str) -> Iterator[Block]:
        """A list; notes among its items stand between the parts of it."""
        p, facts = self.page, {"ordered": True} if tag == "ol" else {}
        first = whole_number(p.attrs[k].get("start"))
        part = Block("list", k, [], facts | ({"start_index": first} if tag == "ol" and first > 1 else {}))
        for c in p.elements_in(k):
            if p.tag[c] != "li":
                continue
            self.seen.add(c)
            if self.is_note(c):
                if part.content:
                    part.end = part_end
                    yield part
                    part = Block("list", k, [], facts)
                yield from self.filled("note", c)
            else:
                part.content += self.filled("listitem", c)
                part_end = p.last[c]
        if part.content:
            yield part

    def lines(self, k: int) -> Iterator[Block]:
        p = self.page
        for c in filter(self.included, p.elements_in(k)):
            if p.tag[c] in {"thead", "tbody", "tfoot"}:
                yield from self.lines(c)
            elif p.tag[c] == "tr" and (cells := [self.cell(x) for x in p.elements_in(c) if p.tag[x] in {"td", "th"} and self.included(x)]):
                yield Block("tablerow", c, cells)

    def cell(self, k: int) -> Block:
        spans = {s: n for s in ("colspan", "rowspan") if (n := whole_number(self.page.attrs[k].get(s))) > 1}
        facts = ({"header": True} if self.page.tag[k] == "th" else {}) | spans
        content = self.blocks(k) if self.has_blocks(k) else [Block("paragraph", k, s) for s in [self.inline(k)] if s]
        return Block("tablecell", k, content, facts)

    # text

    def span(self, k: int, text: str, shifts: list, styles: tuple, url: str | None = None) -> Span:
        nfc, more = composed(text)
        return Span(nfc, styles, url, self.stream.get(k), chained(more, shifts) if more else shifts)

    def pieces(self, k: int, exact: bool, styles: tuple, url: str | None) -> Iterator[Span]:
        p = self.page
        for c in p.kids[k]:
            tag = p.tag[c]
            if tag is None:
                text, shifts = (p.text[c], []) if exact else squeeze(p.text[c])
                if text:
                    yield self.span(c, text, shifts, styles, url)
            elif not self.included(c):
                continue
            elif tag == "br":
                yield Span("\n", url=url)
            elif tag == "img":
                if label := picture_text(p.attrs[c]):
                    yield Span(label, url=url)
            elif tag == "a" and re.match("https?://", p.attrs[c].get("href", "")):
                yield from self.pieces(c, exact, styles, url or p.attrs[c]["href"])
            elif tag == "a" and p.attrs[c].get("href"):
                self.links.append((c, p.attrs[c]["href"]))
                yield from self.pieces(c, exact, styles, url)
            elif tag in STYLES:
                yield from self.pieces(c, exact, tuple(sorted({*styles, STYLES[tag]})), url)
            elif tag not in TYPES:
                yield from self.pieces(c, exact, styles, url)

    def inline(self, k: int, exact: bool = False) -> list[Span]:
        """Spans of an element; neighbours without anchors of their own unite if they look alike."""
        out: list[Span] = []
        for s in self.pieces(k, exact, (), None):
            before = out[-1] if out else None
            if before and s.stream is None and before.stream is None and (s.styles, s.url) == (before.styles, before.url):
                before.text += s.text
            else:
                out.append(s)
        return out


def escaped(name: str) -> str:
    """A CSS identifier."""
    out = []
    for i, c in enumerate(name):
        leading_digit = c.isascii() and c.isdigit() and (i == 0 or (i == 1 and name[0] == "-"))
        if c == "\0":
            out.append("�")
        elif c < " " or c == "\x7f" or leading_digit:
            out.append(f"\\{ord(c):x} ")
        elif c >= "\x80" or c.isalnum() or c == "_" or (c == "-" and len(name) > 1):
            out.append(c)
        else:
            out.append("\\" + c)
    return "".join(out)


def selector(page: PageIndex, k: int) -> str | None:
    """The path from body to an element, cut at the nearest id."""
    steps: list[str] = []
    while k >= 0 and k != page.body:
        if name := page.attrs[k].get("id"):
            steps.append("#" + escaped(name))
            break
        if page.parent[k] < 0:
            break
        kin = page.elements_in(page.parent[k])
        alike = [c for c in kin if page.tag[c] == page.tag[k]]
        choices = ((len(alike) == 1, ""), (kin[0] == k, ":first-child"), (alike[0] == k, ":first-of-type"), (kin[-1] == k, ":last-child"), (alike[-1] == k, ":last-of-type"))
        steps.append(page.tag[k] + next((s for ok, s in choices if ok), f":nth-child({kin.index(k) + 1})"))
        k = page.parent[k]
    return " > ".join(reversed(steps)) or None


def _flat(blocks: list[Block], page: PageIndex, at: tuple = ()) -> Iterator[dict]:
    for i, b in enumerate(blocks):
        leaf = bool(b.content) and isinstance(b.content[0], Span)
        empty = not b.content and b.type in {"heading", "paragraph", "caption", "preformatted", "image"}
        yield {
            "ref": [*at, i], "type": b.type, "tag": page.tag[b.node], "pre": b.node, "selector": selector(page, b.node) if page.tag[b.node] else None, **b.facts,
            "text": "".join(s.text for s in b.content) if leaf else "" if empty else None,
            "spans": [{"text": s.text, "styles": list(s.styles), "url": s.url, "stream": s.stream, "deltas": [{"at": a, "delta": d} for a, d in s.deltas]} for s in b.content] if leaf else None,
        }
        if not leaf:
            yield from _flat(b.content, page, (*at, i))


def block_rows(html: str | None, filtered: bool = True, closed: bool = False) -> list[dict]:
    """The blocks of a page, of its article alone where one is found. Without a body there are none. closed as in
    `folia.sources.html.tree`."""
    page = PageIndex(tree(html, closed))
    if page.body is None:
        return []
    return list(_flat(Converter(page, article(page) if filtered else None).blocks(page.body), page))


def page_blocks(pages: DataFrame, filtered: bool = True, closed: bool = False) -> DataFrame:
    """A row per block of every page: see SCHEMA. block_no is the place in reading order."""
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def rows(page_id, html):
        for n, r in enumerate(block_rows(html, filtered, closed)):
            yield (page_id, n, *(r.get(c) for c in columns[2:]))

    return by_row(pages.select("page_id", "html"), rows, SCHEMA)


def outline(blocks: DataFrame) -> DataFrame:
    """page_id, block, level, title, parent: top-level headings with text, each below the latest one of a smaller level."""
    heads = blocks.filter((F.col("type") == "heading") & (F.size("ref") == 1)).select("page_id", F.col("ref")[0].alias("block"), "level", F.trim("text").alias("title")).filter("title <> ''")
    before = Window.partitionBy("page_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.max(F.when(F.col("level") == k, F.col("block"))).over(before) for k in range(1, 6)]
    return heads.withColumn("parent", F.greatest(*[F.when(F.lit(k) < F.col("level"), x) for k, x in enumerate(latest, 1)], F.lit(None).cast("int")))


def full_text(blocks: DataFrame) -> DataFrame:
    """page_id, n_blocks, text: the leaves' texts in reading order, one line end between them."""
    leaves = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("block_no", "text"))))
    return blocks.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_join(F.transform(leaves, lambda x: x["text"]), "\n").alias("text"))
