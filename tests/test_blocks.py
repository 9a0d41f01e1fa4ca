"""Block trees, the readability filter, shifts and selectors on small pages."""

import random
import unicodedata

from folia.operators.article import article, article_elements
from folia.operators.blocks import block_rows, chained, composed, escaped, full_text, outline, page_blocks, picture_text, squeeze
from folia.sources.html import tree
from folia.sources.page_index import PageIndex, units

LONG = "Some sentence of the article, with a comma, and then more words. " * 5


def short(html, filtered=False):
    return [(".".join(map(str, r["ref"])), r["type"], r.get("text")) for r in block_rows(html, filtered)]


def test_block_rules():
    assert short("<body>a<p></p><div> </div><div><b>b</b> c</div><h2></h2>") == [
        ("0", "paragraph", "a"), ("1", "paragraph", ""), ("2", "paragraph", " "), ("3", "paragraph", "b c"), ("4", "heading", "")]
    assert short("<body><span>x<p>y</p></span><b>k<ul><li>gone</ul>l</b>") == [("0", "paragraph", "x"), ("1", "paragraph", "y"), ("2", "paragraph", "k"), ("3", "list", None), ("3.0", "listitem", "gone"), ("4", "paragraph", "l")]
    assert short("<body><p>k<span><h1>gone</h1></span>l") == [("0", "paragraph", "kl")]  # a span holds the heading, so p stays open
    assert short("<body><ul><li></ul><blockquote></blockquote><table></table><script>x</script>") == []
    assert short("<body><li>z<li>") == [("0", "list", None), ("0.0", "listitem", "z")]
    assert [r.get("start_index") for r in block_rows("<body><ol start=' 4x'><li>a</ol><ol start=1><li>b</ol>", False) if r["type"] == "list"] == [4, None]
    cells = [r for r in block_rows("<body><table><thead><tr><th colspan=2>h</thead><tr><td rowspan=1></table>", False) if r["type"] == "tablecell"]
    assert [(c.get("header"), c.get("colspan"), c.get("rowspan")) for c in cells] == [(True, 2, None), (None, None, None)]
    assert block_rows(None) == block_rows("") == block_rows("<p>no body") == []


def test_spans():
    (p,) = block_rows('<body><p>a<b>b<i>c</i></b><a href="http://u">d<br>e</a><a href="#f">g</a>', False)
    assert [(s["text"], s["styles"], s["url"]) for s in p["spans"]] == [
        ("a", [], None), ("b", ["bold"], None), ("c", ["bold", "italic"], None), ("d", [], "http://u"), ("\n", [], "http://u"), ("e", [], "http://u"), ("g", [], None)]
    assert [s["stream"] for s in p["spans"]] == [0, 1, 2, 3, None, 4, 5]


def test_picture_text():
    assert [picture_text({"alt": a}) for a in ("a.PNG", "x/y", "data:1", "a nice.png", " cat ", "")] == ["", "", "", "a nice.png", "cat", ""]
    assert picture_text({"alt": "cat", "aria-label": " dog "}) == "dog"


def test_shifts_lead_back():
    rng = random.Random(5)
    for _ in range(2000):
        raw = "".join(rng.choice(["a", " ", "\n", "é", "́", "\U0001d15e", "b", "ộ", "ᄀ", "ᅡ"]) for _ in range(10))
        flat, one = squeeze(raw)
        nfc, two = composed(flat)
        assert nfc == unicodedata.normalize("NFC", flat)
        both = chained(two, one) if two else one
        assert units(nfc) - (both[-1][1] if both else 0) == units(raw)
    raw = "x  é y"
    flat, one = squeeze(raw)
    nfc, two = composed(flat)
    at = lambda x: x - next((d for k, d in reversed(chained(two, one)) if k <= x), 0)
    assert [raw[at(i)] for i in (0, 2, 3, 4)] == ["x", "e", " ", "y"]


def test_selectors():
    rows = block_rows("<body><div><p>a<p>b<p>c<p>d</div><div id='9 a'><p>e</div>", False)
    assert [r["selector"] for r in rows] == [
        "div:first-child > p:first-child", "div:first-child > p:nth-child(2)", "div:first-child > p:nth-child(3)", "div:first-child > p:last-child", "#\\39 \\ a > p"]
    assert [escaped(x) for x in ("-", "-1", "a.b", "\x01", "é_")] == ["\\-", "-\\31 ", "a\\.b", "\\1 ", "é_"]


def kept_text(html):
    page = PageIndex(tree(html))
    kept = article(page)
    return None if kept is None else "".join(page.text[c] for k in sorted(kept) for c in page.kids[k] if page.tag[c] is None)


def test_article():
    body = f"<div class=story><h1>Head line</h1><p>{LONG}</p><p>{LONG}</p></div>"
    html = f"<body><div class=sidebar><p>{LONG}</p></div><nav role=navigation><ul><li><a href=x>menu</a></ul></nav>{body}<footer>foot</footer><div hidden>{LONG}</div></body>"
    text = kept_text(html)
    assert text == "Head line" + LONG * 2
    assert kept_text(f"<body>{body.replace('</div>', '<form><input><input>' + '<a href=y>send</a></form><aside>more</aside><div class=share>Share</div></div>')}") == text
    assert kept_text("<body><div class=banner>short</div>") == "short"  # the lenient attempts
    assert kept_text("<body></body>") is None and kept_text("<p>x") is None
    data = "<table><tr><th>k<th>v<tr><td>1<td>2</table>"
    assert "12" in kept_text(f"<body><div><p>{LONG}</p>{data}<p>{LONG}</p></div>")


def test_tables(spark):
    rows = [(1, f"<body><h1>A</h1><p>{LONG}<p>{LONG}<h3>B</h3><p>t<h2>C</h2><p>{LONG}"), (2, None), (3, ""), (4, "<body><p>x"), (4, "<body><p>x")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, html string, pre string")
    blocks = page_blocks(pages, False).cache()
    assert [(r.title, r.level, r.parent) for r in outline(blocks).orderBy("block").collect()] == [("A", 1, None), ("B", 3, 0), ("C", 2, 0)]
    assert {r.page_id: r.n_blocks for r in full_text(blocks).collect()} == {1: 7, 4: 2}
    assert sorted((r.page_id, r.found) for r in article_elements(pages).collect()) == [(1, True), (4, True), (4, True)]
    assert page_blocks(pages.limit(0)).count() == 0
