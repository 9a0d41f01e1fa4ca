"""Sections of books: blocks, anchors, markers, notes and places of the contents."""

import io
import zipfile

from folia.operators.blocks import block_rows
from folia.sources.epub import packages
from folia.sources.sections import contents_places, note_links, sections, sections_of

OPF = """<package><metadata><dc:title>T</dc:title></metadata><manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b%20c.xhtml"/>
<item id="p" href="p.png" media-type="image/png"/><item id="n" href="nav.xhtml" properties="nav"/></manifest><spine><itemref idref="a"/><itemref idref="p"/><itemref idref="b"/></spine></package>"""
NAV = '<nav epub:type="toc"><ol><li><a href="t/a.xhtml">A</a></li><li><a href="t/b%20c.xhtml#two">B</a></li><li><a href="t/b%20c.xhtml#none">C</a></li><li><a href="x.xhtml">D</a></li></ol></nav>'
A = """<html><head><title>t</title></head><body><h1 id="page_12">Head</h1><p>Text<a epub:type="noteref" href="#f1">1</a> <a href="b%20c.xhtml#two">2</a><a role="doc-link" href="#f1">3</a><a href="#f2">4</a><a href="a.xhtml#two">5</a></p>
<span id="page3"></span><div epub:type="pagebreak" title="iv"/><aside id="f1" epub:type="footnote"><p>Note one</p></aside>
<ol><li>item</li><li id="f2" epub:type="endnote">Note two</li><li>last</li></ol></body></html>"""
B = '<html><body><p>one</p><div><p id="two">two</p></div></body></html>'


def book():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        box = '<container><rootfiles><rootfile full-path="O/a.opf"/></rootfiles></container>'
        for name, text in (("META-INF/container.xml", box), ("O/a.opf", OPF), ("O/nav.xhtml", NAV), ("O/t/a.xhtml", A), ("O/t/b c.xhtml", B), ("O/p.png", "x")):
            z.writestr(name, text)
    return raw.getvalue()


def test_sections():
    rows = sections_of(book())
    at = lambda kind, *names: [tuple(r.get(n) for n in names) for r in rows if r["kind"] == kind]
    assert at("section", "spine", "name") == [(0, "O/t/a.xhtml"), (1, "O/p.png"), (2, "O/t/b c.xhtml")]
    assert at("block", "spine", "block", "type", "text") == [
        (0, 0, "heading", "Head"), (0, 1, "paragraph", "Text1 2345"), (0, 2, "note", "Note one"), (0, 3, "list", "item"), (0, 4, "note", "Note two"), (0, 5, "list", "last"),
        (2, 0, "paragraph", "one"), (2, 1, "paragraph", "two")]
    assert at("block", "cfi")[0] == ("/6/2!/4/2",) and at("block", "cfi")[-1] == ("/6/6!/2/4/2",)
    assert at("id", "name", "block") == [("page_12", 0), ("page3", 2), ("f1", 2), ("f2", 4), ("two", 1)]
    assert at("marker", "type", "name", "block") == [("id", "12", 0), ("id-empty", "3", 2), ("id", "3", 2), ("type", "iv", 2)]
    assert sections_of(None) == sections_of(b"no book") == []
    assert [r["type"] for r in block_rows(A, False)][:3] == ["heading", "paragraph", "paragraph"]  # pages know no notes


def test_places(spark):
    books = spark.createDataFrame([(1, bytearray(book())), (2, None), (3, bytearray(b"no book"))], "doc_id long, bytes binary")
    rows = sections(books).cache()
    assert [(r.source, r.target, r.back) for r in note_links(rows).orderBy("target").collect()] == [(1, 2, [1]), (1, 4, [1])]
    got = contents_places(packages(books), rows).orderBy("ord").collect()
    assert [(r.label, r.place) for r in got] == [("A", 0), ("B", 7), ("C", None), ("D", None)]
