"""The readability filter: which elements of a page belong to its article.

A page is weighed as a whole (scores climb from paragraphs to ancestors, the winner takes in siblings, cleaning passes
depend on each other), so it is one fold per page over the flat element table; pages are independent of each other and
no exchange is needed. Pages without a body have no row; pages without text keep nothing and `found` is false.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from folia.sources.html import tree
from folia.sources.page_index import PageIndex, squeezed, units

# Name patterns, tag sets and thresholds of the readability method.
UNLIKELY = re.compile("-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote", re.I)
MAYBE = re.compile("and|article|body|column|content|main|mathjax|shadow", re.I)
POSITIVE = re.compile("article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile("-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)
VIDEO = re.compile(r"//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq|bilibili|live.bilibili)\.com|(archive|upload\.wikimedia)\.org|player\.twitch\.tv)", re.I)
SHARE = re.compile(r"(\b|_)(share|sharedaddy)(\b|_)", re.I)
COMMAS = re.compile("[,،﹐︐︑⹁⸴⸲，]")
AD = re.compile("(ad(vertising|vertisement)?|pub(licité)?|werb(ung)?|广告|Реклама|Anuncio)", re.I)
LOADING = re.compile(r"(loading|正在加载|Загрузка|chargement|cargando)(…|\.\.\.)?", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
UNLIKELY_ROLES = {"menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog"}
SCORED = {"section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre"}
BLOCKS = {"blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DATA_PARTS = {"col", "colgroup", "tfoot", "thead", "th"}
EMBEDS = {"object", "embed", "iframe"}
BASE_SCORE = {"div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys(["address", "ol", "ul", "dl", "dd", "dt", "li", "form"], -3) | dict.fromkeys([*sorted(HEADINGS), "th"], -5)
TOP_CANDIDATES, ENOUGH_TEXT, SCORED_ANCESTORS, SHORTEST, CLASS_POINTS = 5, 500, 5, 25, 25

#: (strip unlikely names, weigh class names, clean by heuristics), from strict to lenient.
ATTEMPTS = [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]
#: The cleaning passes in their order: a method of _Weighing and its tag.
PASSES = [
    ("doubtful", "form"), ("doubtful", "fieldset"), ("tagged", "object"), ("tagged", "embed"), ("tagged", "footer"), ("tagged", "link"), ("tagged", "aside"),
    ("sharing", None), ("tagged", "iframe"), ("tagged", "input"), ("tagged", "textarea"), ("tagged", "select"), ("tagged", "button"), ("titles", None),
    ("doubtful", "table"), ("doubtful", "ul"), ("doubtful", "div"),
]


def _span(value: str | None) -> int:
    m = re.match(r"\s*\+?(\d+)", value or "")
    return max(1, int(m[1])) if m else 1


class _Weighing:
    """One attempt at a page. gone marks elements that count as absent, always with their subtrees."""

    def __init__(self, page: PageIndex, strip: bool, weigh: bool, clean: bool):
        self.page, self.strip, self.weigh, self.clean = page, strip, weigh, clean
        self.gone = bytearray(len(page.tag))
        self.kept: set[int] = set()
        self.score: dict[int, float] = {}
        self.like_p: set[int] = set()
        self.data_tables: set[int] = set()
        self._texts: dict[int, str] = {}

    # measures

    def names(self, k: int) -> str:
        a = self.page.attrs[k]
        return f"{a.get('class', '')} {a.get('id', '')}"

    def raw(self, k: int) -> str:
        p, gone = self.page, self.gone
        return "" if gone[k] else "".join(p.text[i] for i in range(k + 1, p.last[k] + 1) if p.tag[i] is None and not gone[p.parent[i]])

    def text(self, k: int) -> str:
        if k not in self._texts:
            self._texts[k] = squeezed(self.raw(k))
        return self._texts[k]

    def size(self, k: int) -> int:
        return units(self.text(k))

    def share(self, k: int, weights: list[tuple[int, float]]) -> float:
        whole = self.size(k)
        return sum(self.size(i) * w for i, w in weights) / whole if whole else 0.0

    def link_share(self, k: int) -> float:
        p = self.page
        return self.share(k, [(a, 0.3 if re.match("#.", p.attrs[a].get("href", "")) else 1.0) for a in p.below(k, {"a"})])

    def text_share(self, k: int, tags: set[str]) -> float:
        return self.share(k, [(i, 1.0) for i in self.page.below(k, tags)])

    def class_points(self, k: int) -> int:
        if not self.weigh:
            return 0
        named = [v for v in (self.page.attrs[k].get("class"), self.page.attrs[k].get("id")) if v]
        return CLASS_POINTS * sum(bool(POSITIVE.search(v)) - bool(NEGATIVE.search(v)) for v in named)

    def live_kids(self, k: int) -> list[int]:
        return [c for c in self.page.elements_in(k) if not self.gone[c]]

    def under(self, k: int, tag: str, wanted: Callable[[int], bool] = lambda _: True) -> bool:
        for a in self.page.above(k):
            if self.gone[a]:
                return False
            if self.page.tag[a] == tag and wanted(a):
                return True
        return False

    def remove(self, k: int) -> None:
        for i in range(k, self.page.last[k] + 1):
            if self.page.tag[i]:
                self.gone[i] = 1
                self.kept.discard(i)
        self._texts.clear()

    # pruning and scoring

    def absent(self, k: int) -> bool:
        p = self.page
        a, tag = p.attrs[k], p.tag[k]
        if UNSEEN.search(a.get("style", "")) or "hidden" in a:
            return True
        if a.get("aria-hidden") == "true" and "fallback-image" not in a.get("class", ""):
            return True
        role = a.get("role")
        if role == "dialog" and a.get("aria-modal") == "true":
            return True
        if self.strip:
            named = self.names(k)
            if tag != "a" and UNLIKELY.search(named) and not MAYBE.search(named) and not self.under(k, "table") and not self.under(k, "code"):
                return True
            if role in UNLIKELY_ROLES:
                return True
        hollow = tag in HEADINGS or tag in {"div", "section", "header"}
        return hollow and not any((p.text[c] or "").strip() for c in p.kids[k]) and all(p.tag[c] in {"br", "hr"} for c in p.elements_in(k))

    def paragraphs(self) -> list[int]:
        """Prunes the page; the elements whose text is scored, some of them twice."""
        p, out = self.page, []
        for k in range(p.body + 1, p.last[p.body] + 1):
            tag = p.tag[k]
            if tag is None or self.gone[k]:
                continue
            if self.absent(k):
                self.remove(k)
                continue
            if tag in SCORED:
                out.append(k)
            if tag == "div":
                kids = self.live_kids(k)
                bare = not any(re.search(r"\S\Z", p.text[c]) for c in p.kids[k] if p.tag[c] is None)
                if bare and [p.tag[c] for c in kids] == ["p"] and self.link_share(k) < 0.25:
                    out += kids
                elif not any(not self.gone[i] for i in p.below(k, BLOCKS)):
                    self.like_p.add(k)
                    out.append(k)
        return out

    def start(self, k: int) -> None:
        tag = "p" if k in self.like_p else self.page.tag[k]
        self.score.setdefault(k, BASE_SCORE.get(tag, 0) + self.class_points(k))

    def candidates(self) -> list[int]:
        """The best scored ancestors, best first; of equal ones the first met."""
        p = self.page
        for k in self.paragraphs():
            if self.gone[k] or p.parent[k] < 0 or self.size(k) < SHORTEST:
                continue
            points = 2 + len(COMMAS.findall(self.text(k))) + min(self.size(k) // 100, 3)
            for level, a in zip(range(SCORED_ANCESTORS), p.above(k)):
                if not self.gone[a] and p.parent[a] >= 0:
                    self.start(a)
                    self.score[a] += points / (1, 2, 6, 9, 12)[level]
        for k in self.score:
            self.score[k] *= 1 - self.link_share(k)
        return sorted(self.score, key=lambda k: -self.score[k])[:TOP_CANDIDATES]

    # the article

    def climbed(self, best: list[int]) -> int:
        """The winner, moved up where an ancestor stands for more of the article."""
        p, score, top = self.page, self.score, best[0]
        inside = lambda k: [a for a in p.above(k) if p.body < a]
        rivals = [set(p.above(k)) for k in best[1:] if score[top] > 0 and score[k] / score[top] >= 0.75]
        top = next((a for a in inside(top) if sum(a in r for r in rivals) >= 3), top)
        self.start(top)
        seen, least = score[top], score[top] / 3
        for a in inside(top):
            if a not in score:
                continue
            if score[a] < least:
                break
            if score[a] > seen:
                top = a
                break
            seen = score[a]
        for a in inside(top):
            if len(self.live_kids(a)) != 1:
                break
            top = a
        self.start(top)
        return top

    def joins(self, k: int, top: int) -> bool:
        """Whether a sibling of the winner belongs to the article."""
        p, best = self.page, self.score[top]
        style = p.attrs[top].get("class", "")
        bonus = 0.2 * best if style and p.attrs[k].get("class", "") == style else 0
        if k in self.score and self.score[k] + bonus >= max(10, 0.2 * best):
            return True
        if p.tag[k] != "p":
            return False
        size, links = self.size(k), self.link_share(k)
        return (size > 80 and links < 0.25) or (0 < size < 80 and links == 0 and bool(re.search(r"\.( |\Z)", self.text(k))))

    def gather(self) -> None:
        p, best = self.page, self.candidates()
        if best and best[0] != p.body:
            top = self.climbed(best)
            roots = [k for k in self.live_kids(p.parent[top]) if k == top or self.joins(k, top)]
        else:
            roots = [p.body]
        self.kept = {i for r in roots for i in range(r, p.last[r] + 1) if p.tag[i] and not self.gone[i]}
        self.data_tables = {k for k in self.kept if p.tag[k] == "table" and self.holds_data(k)}
        for name, tag in PASSES:
            for k in sorted(self.kept):
                if k in self.kept and (tag is None or p.tag[k] == tag) and getattr(self, name)(k):
                    self.remove(k)

    # cleaning

    def holds_data(self, k: int) -> bool:
        p, a = self.page, self.page.attrs[k]
        if a.get("role") == "presentation" or a.get("datatable") == "0":
            return False
        captions = p.below(k, {"caption"})
        if a.get("summary") or (captions and p.kids[captions[0]]) or p.below(k, DATA_PARTS):
            return True
        if p.below(k, {"table"}):
            return False
        lines = p.below(k, {"tr"})
        n_rows = sum(_span(p.attrs[r].get("rowspan")) for r in lines)
        n_columns = max((sum(_span(p.attrs[c].get("colspan")) for c in p.below(r, {"td"})) for r in lines), default=0)
        if n_rows == 1 or n_columns == 1:
            return False
        return n_rows >= 10 or n_columns > 4 or n_rows * n_columns > 10

    def shows_video(self, k: int) -> bool:
        return any(VIDEO.search(v) for v in self.page.attrs[k].values())

    def tagged(self, k: int) -> bool:
        p = self.page
        within = [i for i in range(k, p.last[k] + 1) if p.tag[i]] if p.tag[k] == "object" else [k]
        return p.tag[k] not in EMBEDS or not any(self.shows_video(i) for i in within)

    def sharing(self, k: int) -> bool:
        return bool(SHARE.search(self.names(k))) and units(self.raw(k)) < ENOUGH_TEXT

    def titles(self, k: int) -> bool:
        return self.page.tag[k] in {"h1", "h2"} and self.class_points(k) < 0

    def doubtful(self, k: int) -> bool:
        """Whether an element looks like anything but content."""
        p, data = self.page, self.data_tables
        if not self.clean or k in data or self.under(k, "table", data.__contains__) or self.under(k, "code") or data.intersection(p.below(k, {"table"})):
            return False
        points = self.class_points(k)
        if points < 0:
            return True
        text, embeds = self.text(k), p.below(k, EMBEDS)
        if text.count(",") >= 10 or any(self.shows_video(e) for e in embeds):
            return False
        if AD.fullmatch(text) or LOADING.fullmatch(text):
            return True
        whole = units(self.raw(k))
        listing = p.tag[k] == "ul" or (whole > 0 and sum(units(self.raw(i)) for i in p.below(k, {"ul", "ol"})) / whole > 0.9)
        n = {t: len(p.below(k, {t})) for t in ("p", "img", "li", "input")}
        size, links, in_figure = units(text), self.link_share(k), self.under(k, "figure")
        signs = (
            not in_figure and n["img"] > 1 and n["p"] / n["img"] < 0.5,
            not listing and n["li"] - 100 > n["p"],
            n["input"] > n["p"] // 3,
            not listing and not in_figure and size < 25 and (n["img"] == 0 or n["img"] > 2) and links > 0 and self.text_share(k, HEADINGS) < 0.9,
            not listing and points < 25 and links > 0.2,
            points >= 25 and links > 0.5,
            len(embeds) > 1 or (len(embeds) == 1 and size < 75),
            n["img"] == 0 and self.text_share(k, {"span", "li", "td"} | BLOCKS) == 0,
        )
        if not any(signs):
            return False
        pictures = listing and n["img"] == n["li"] and all(len(self.live_kids(c)) <= 1 for c in self.live_kids(k))
        return not pictures

    def kept_size(self) -> int:
        p = self.page
        return sum(units(p.text[i]) for k in self.kept for i in p.kids[k] if p.tag[i] is None)


def article(page: PageIndex) -> set[int] | None:
    """Pre-order numbers of the article's elements with their ancestors below body; None if there is no text."""
    if page.body is None:
        return None
    best: set[int] = set()
    most = 0
    for attempt in ATTEMPTS:
        w = _Weighing(page, *attempt)
        w.gather()
        size = w.kept_size()
        if size > most:
            best, most = w.kept, size
        if size >= ENOUGH_TEXT:
            best, most = w.kept, size
            break
    if not most:
        return None
    return best | {a for k in best for a in page.above(k) if page.body < a}


def article_elements(pages: DataFrame) -> DataFrame:
    """page_id, found, n_elements, kept: a row per page with a body."""

    def run(frames):
        for f in frames:
            out = []
            for page_id, html in zip(f.page_id, f.html, strict=True):
                page = PageIndex(tree(html))
                if page.body is not None:
                    kept = article(page)
                    out.append((page_id, kept is not None, sum(t is not None for t in page.tag), sorted(kept or ())))
            yield pd.DataFrame(out, columns=["page_id", "found", "n_elements", "kept"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, found boolean, n_elements int, kept array<int>")
