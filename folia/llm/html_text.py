"""Main text of web pages by nearest-URL differencing, which page structure corrects.

Every page is read into lines, one per block, each with what structure says of it: ARTICLE (inside an article), BOILER
(in menus, headers, footers, sidebars, notices, adverts, forms, reader comments, hidden elements: by element, role,
class or id) or OPEN (anything else). Where a <main> holds text, lines outside it are BOILER.

Every page is paired with its nearest neighbours by URL path within the host, and their whole line sequences are
aligned by longest common subsequence. A line that is shared with a neighbour, and that enough pages of the host have
outside articles which aren't copies, is template and deleted: a page that shares COPY_SHARE of its characters with
the page before it is a copy and doesn't count. Lines known to be BOILER on one page are evidence against the same
lines that stand in the open on another. Structure then corrects both errors of differencing: ARTICLE lines stay
though pages share them (passages that two articles have in common), BOILER lines go though no other page has them
(adverts and menus of one page). Where no line would be left at all the OPEN ones stay. `decisions` counts the lines
by what structure and differencing say of them.

Neighbours are found in a range-partitioned sort over host and path, with the pieces' ends put together in a second
small step: a host with a third of all pages is spread over many tasks. Texts aren't shuffled, but for pages with OPEN
lines; pages are compared by hashes of their lines.

Edge cases. A null html is empty and gives empty text. A null url belongs to the empty host and path. Rows that repeat
a page_id or url are pages of their own. An empty table gives no rows. Other columns are ignored. A '<' that begins no
known element and meets another '<' before its '>' is text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from html import unescape
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, shuffle_width, stored

# HTML's element kinds and the names that pages give to parts that aren't text.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "math", "canvas", "audio", "video"}
#: Of these, the kinds whose content is text up to an end tag; the others can close themselves or stay unclosed.
RAW_TEXT = {"script", "style", "noscript", "iframe", "textarea", "title"}
UNNESTED = {"audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
DROPPED_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "sidebar", "sidenav", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "comment", "comments", "commentlist", "disqus", "reply", "replies", "share", "sharing", "social", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "widget", "toolbar", "skip",
}
#: Words that may stand beside one of these in a class or id: "top-ad" is an advert, "with-sidebar" is a layout.
PLACES = {
    "top", "bottom", "site", "page", "main", "global", "primary", "secondary", "box", "bar", "block", "container", "wrapper", "wrap", "slot", "unit",
    "list", "item", "items", "link", "links", "area", "section", "panel", "post", "posts", "blog", "article", "articles", "user", "reader",
}
DROPPED_IN_TEXT = {"comment", "comments", "reply", "related", "sponsored", "advert"}
#: Share of characters from which a page is a copy of the one before it; pages of a host that make a line a template.
COPY_SHARE = 0.8
LEAST_PAGES, MOST_PAGES = 2, 5
#: Elements whose start closes an open <p>, and those that close an open one of their kind.
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_MARKUP = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[A-Za-z/!?][^<>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_NAME = re.compile(r"[A-Za-z]+")
_BLANK = re.compile(r"\s+")
_KNOWN = RAW | VOID | INLINE | DROPPED | CLOSES_P | {"html", "body", "option", "optgroup", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "col", "colgroup", "summary", "legend", "picture", "slot", "frameset", "frame"}

ARTICLE, OPEN, BOILER = 1, 0, 2
MOST_BROADCAST = 500_000


def _named(value: str, names: set[str]) -> bool:
    """Whether a class or id has a token made of names, and beside them of PLACES only."""
    for token in value.split():
        words = _NAME.findall(token)
        if any(x in names for x in words) and all(x in names or x in PLACES for x in words):
            return True
    return False


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape("".join(values)).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in DROPPED_ROLES):
            return True
        if name in ("class", "id") and tag not in ("article", "main") and _named(value, DROPPED_NAMES):
            return True
        if name == "class" and tag in ("article", "main") and _named(value, DROPPED_IN_TEXT):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def marked_lines(html: str | None) -> list[tuple[str, int]]:
    """The page's lines in order, each with ARTICLE, OPEN or BOILER."""
    html = html or ""
    out: list[tuple[str, int]] = []
    stack: list[str] = []  # open elements
    dropping = 0  # length of the stack when the outermost unwanted element opened, else 0
    buffer: list[str] = []
    aside: list[str] = []  # the same for text in unwanted elements
    articles = mains = 0
    spots: list[bool] = []  # whether each line stands in <main>

    def end_line() -> None:
        for part, kind in ((buffer, ARTICLE if articles else OPEN), (aside, BOILER)):
            if part:
                text = _BLANK.sub(" ", unescape("".join(part))).strip()
                part.clear()
                if text:
                    out.append((text, kind))
                    spots.append(mains > 0)

    def pop_to(n: int) -> None:
        nonlocal dropping, articles, mains
        for tag in stack[n:]:
            articles -= tag == "article"
            mains -= tag == "main"
        del stack[n:]
        if dropping and len(stack) < dropping:
            dropping = 0

    at = 0
    while True:
        m = _MARKUP.search(html, at)
        if m is None or m.start() > at:
            (aside if dropping else buffer).append(html[at : m.start() if m else len(html)])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in _KNOWN and "<" in m[3] and "-" not in tag:
            (aside if dropping else buffer).append("<")
            at = m.start() + 1
            continue
        if m[1]:
            if tag not in INLINE:
                end_line()
            if tag in stack:
                n = len(stack) - 1 - stack[::-1].index(tag)
                if tag not in INLINE or not any(x not in INLINE for x in stack[n:]):
                    pop_to(n)
            continue
        if tag == "br":
            (aside if dropping else buffer).append(" ")
            continue
        if tag not in INLINE:
            end_line()
            if tag in CLOSES_P and "p" in stack:
                n = len(stack) - 1 - stack[::-1].index("p")
                if not any(x in ("button", "table", "td", "th", "object") for x in stack[n + 1 :]):
                    pop_to(n)
            for kind in SIBLINGS.get(tag, ()):
                if kind in stack:
                    n = len(stack) - 1 - stack[::-1].index(kind)
                    if not any(x in FENCES.get(tag, ()) for x in stack[n + 1 :]):
                        pop_to(n)
        if tag in RAW:
            if tag not in RAW_TEXT and m[3].rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
            if end is None:
                at = len(html) if tag in RAW_TEXT else at
            elif tag not in UNNESTED or not re.compile(rf"<{tag}[\s/>]", re.I).search(html, at, end.start()):
                at = end.end()
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in ("p", "div", "article", "section", "a"):
            continue
        stack.append(tag)
        articles += tag == "article"
        mains += tag == "main"
        if not dropping and _unwanted(tag, m[3], articles > 0):
            dropping = len(stack)
        if tag == "body" and dropping and "head" in stack:
            pop_to(stack.index("head"))
            stack.append("body")
            dropping = 0
    end_line()
    if any(inside and kind != BOILER for (_, kind), inside in zip(out, spots, strict=True)):
        return [(x, kind if inside else BOILER) for (x, kind), inside in zip(out, spots, strict=True)]
    return out


def lines(html: str | None) -> list[tuple[str, int]]:
    """The page's lines that structure doesn't reject, each with ARTICLE or OPEN."""
    return [(x, kind) for x, kind in marked_lines(html) if kind != BOILER]


def common_lines(a: list, b: list) -> set[int]:
    """Positions in a of one longest common subsequence of a and b (longest increasing run over matching positions)."""
    where = defaultdict(list)
    for j, x in enumerate(b):
        where[x].append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    out, link = set(), chains[-1] if chains else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def read_lines(pages: DataFrame) -> DataFrame:
    """row (a number of its own), page_id, url, host, path; of the lines that aren't BOILER the texts, kinds and hashes;
    of all lines the hashes, kinds and lengths."""

    def run(frames):
        for f in frames:
            got = [marked_lines(h) for h in f.html]
            hashes = [[xxhash.xxh64_intdigest(x) - (1 << 63) for x, _ in p] for p in got]
            urls = [urlsplit(u) if isinstance(u, str) and "[" not in u and "]" not in u else urlsplit("") for u in f.url]
            yield f[["row", "page_id", "url"]].assign(
                host=[u.netloc.lower() for u in urls], path=[u.path for u in urls],
                lines=[[x for x, k in p if k != BOILER] for p in got], kinds=[[k for _, k in p if k != BOILER] for p in got],
                line_hashes=[[h for h, (_, k) in zip(hs, p, strict=True) if k != BOILER] for hs, p in zip(hashes, got, strict=True)],
                hashes=hashes, all_kinds=[[k for _, k in p] for p in got], sizes=[[len(x) for x, _ in p] for p in got],
            )

    numbered = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), "url", "html")
    return numbered.mapInPandas(run, (
        "row long, page_id long, url string, host string, path string, lines array<string>, kinds array<int>, line_hashes array<long>,"
        " hashes array<long>, all_kinds array<int>, sizes array<int>"
    ))


def neighbours(keys: DataFrame) -> DataFrame:
    """row, before, after: the rows next to each by path within its host. keys: row, page_id, host, path."""
    order = ["path", "page_id", "row"]
    dealt = keys.repartitionByRange(shuffle_width(keys.sparkSession), "host", *order).withColumn("piece", F.spark_partition_id())
    dealt = stored(dealt, "page-order")
    w = Window.partitionBy("host", "piece").orderBy(*order)
    inner = dealt.withColumn("before", F.lag("row").over(w)).withColumn("after", F.lead("row").over(w))
    ends = inner.filter("before is null or after is null")  # two rows at most for each host and piece
    h = Window.partitionBy("host").orderBy("piece", *order)
    joined = ends.withColumn("b", F.coalesce("before", F.lag("row").over(h))).withColumn("a", F.coalesce("after", F.lead("row").over(h)))
    return inner.filter("before is not null and after is not null").select("row", "before", "after").unionByName(
        joined.select("row", F.col("b").alias("before"), F.col("a").alias("after"))
    )


def shared_lines(read: DataFrame) -> DataFrame:
    """row, host, head (it isn't a copy of the page before it), shared (hashes of its OPEN lines that a neighbour
    shares, there or in BOILER), and for each kind of line its number and how many a neighbour shares."""
    near = neighbours(read.select("row", "page_id", "host", "path"))
    light = read.select("row", "host", "hashes", "all_kinds", "sizes")
    placed = light.join(near, "row")
    for side in ("before", "after"):
        other = light.select(F.col("row").alias(side), F.col("hashes").alias(f"{side}_hashes"), *([F.col("all_kinds").alias("before_kinds"), F.col("sizes").alias("before_sizes")] if side == "before" else []))
        placed = placed.join(other, side, "left")

    def compare(frames):
        for f in frames:
            out = []
            for kinds, mine, sizes, before, before_kinds, before_sizes, after in zip(f.all_kinds, f.hashes, f.sizes, f.before_hashes, f.before_kinds, f.before_sizes, f.after_hashes, strict=True):
                both = [set() if x is None else common_lines(list(mine), list(x)) for x in (before, after)]
                head = before is None
                if not head:
                    own, other = (sum(n for n, k in zip(ns, ks, strict=True) if k != BOILER) for ns, ks in ((sizes, kinds), (before_sizes, before_kinds)))
                    head = sum(sizes[i] for i in both[0] if kinds[i] != BOILER) < COPY_SHARE * max(own, other, 1)
                found = both[0] | both[1]
                n = [sum(kinds[i] == k for i in some) for k in (ARTICLE, OPEN, BOILER) for some in (range(len(kinds)), found)]
                out.append((head, sorted({mine[i] for i in found if kinds[i] != ARTICLE} & {h for h, k in zip(mine, kinds, strict=True) if k == OPEN}), n))
            yield f[["row", "host"]].assign(**{c: [x[k] for x in out] for k, c in enumerate(("head", "shared", "n"))})

    return placed.drop("before", "after").mapInPandas(compare, "row long, host string, head boolean, shared array<long>, n array<int>")


def template_lines(read: DataFrame, compared: DataFrame) -> DataFrame:
    """row, template (hashes of its OPEN lines that are template) for the rows that have any. read: of read_lines,
    compared: of shared_lines. Only lines that two neighbours share are counted over their host."""
    shared = stored(compared.select("row", "host", F.explode("shared").alias("line")), "page-shared-lines")
    asked = broadcast_if(stored(shared.select("host", "line").distinct(), "shared-lines"), MOST_BROADCAST)
    heads = compared.filter("head").select("row", "host")
    pages = stored(heads.groupBy("host").agg(F.count("*").alias("pages")), "host-pages")
    outside = F.array_distinct(F.filter("hashes", lambda _, i: F.get("all_kinds", i) != ARTICLE))
    seen = read.select("row", "host", F.explode(outside).alias("line")).join(asked, ["host", "line"], "left_semi").join(heads.select("row"), "row", "left_semi")
    counts = seen.groupBy("host", "line").count().filter(F.col("count") >= LEAST_PAGES)
    enough = F.greatest(F.lit(LEAST_PAGES), F.least(F.lit(MOST_PAGES), F.ceil(F.col("pages") / 2)))
    template = stored(counts.join(broadcast_if(pages, MOST_BROADCAST), "host").filter(F.col("count") >= enough).select("host", "line"), "template")
    found = shared.join(broadcast_if(template, MOST_BROADCAST), ["host", "line"])
    return stored(found.groupBy("row").agg(F.collect_set("line").alias("template")), "page-template")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, blocks (array of strings) for every row."""
    read = stored(read_lines(pages), "page-lines")
    template = template_lines(read, stored(shared_lines(read), "page-shared"))
    is_open = F.exists("kinds", lambda k: k == OPEN)
    protected = read.filter(~is_open).select("page_id", "url", F.col("lines").alias("blocks"))
    decided = read.filter(is_open).select("row", "page_id", "url", "lines", "kinds", "line_hashes").join(template, "row", "left")
    kept = lambda x, i: (F.get("kinds", i) == ARTICLE) | ~F.coalesce(F.array_contains("template", F.get("line_hashes", i)), F.lit(False))
    left = F.filter("lines", kept)
    return protected.unionByName(decided.select("page_id", "url", F.when(F.size(left) > 0, left).otherwise(F.col("lines")).alias("blocks")))


def decisions(pages: DataFrame) -> DataFrame:
    """kind, lines, shared: how many lines structure takes for text, leaves open or rejects, and how many of these a
    neighbour shares."""
    compared = shared_lines(stored(read_lines(pages), "page-lines"))
    sums = compared.agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(6)])
    rows = [F.struct(F.lit(k).alias("kind"), F.col(f"n{2 * i}").alias("lines"), F.col(f"n{2 * i + 1}").alias("shared")) for i, k in enumerate(("article", "open", "boiler"))]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def op8_html_text(pages: DataFrame) -> DataFrame:
    text = F.array_join("blocks", "\n\n")
    return main_text(pages).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
