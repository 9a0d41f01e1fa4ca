"""EPUB files as one flat table of package rows: metadata, manifest, spine, table of contents, page list.

A package document or table of contents is small, so each file is read whole by one Arrow batch function; everything
after that is joins and windows over its rows. Files that aren't ZIPs, lack a root file, or hold none of a kind give no
rows of that kind.
"""

from __future__ import annotations

import io
import zipfile
from urllib.parse import unquote

from pyspark.sql import DataFrame

from folia.sources.by_row import by_row
from folia.sources.html import tree

SCHEMA = "doc_id long, kind string, ord int, parent int, depth int, id string, href string, label string, media_type string, properties string, linear boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def resolved(href: str, base: str) -> str:
    """href against the folder base, percent signs decoded, with . and .. resolved; a fragment stays."""
    path, mark, fragment = href.partition("#")
    parts: list[str] = []
    for step in f"{base}/{unquote(path)}".split("/"):
        if step == "..":
            parts = parts[:-1]
        elif step not in ("", "."):
            parts.append(step)
    return "/".join(parts) + mark + fragment


class _Markup:
    """Look-ups in a document's pre-order rows, by local names in lower case."""

    def __init__(self, raw: bytes):
        self.rows = tree(raw.decode("utf-8", "replace").removeprefix("﻿"))

    def name(self, k: int) -> str:
        return (self.rows[k][5] or "").rpartition(":")[2]

    def inside(self, k: int | None, *names: str) -> list[int]:
        """Elements below k (all, if None) that have one of the names."""
        first, last = (0, len(self.rows) - 1) if k is None else (k + 1, self.rows[k][1])
        return [i for i in range(first, last + 1) if self.rows[i][4] == "element" and self.name(i) in names]

    def children(self, k: int) -> list[int]:
        return [i for i in range(k + 1, self.rows[k][1] + 1) if self.rows[i][2] == k and self.rows[i][4] == "element"]

    def get(self, k: int, name: str) -> str:
        return (self.rows[k][6] or {}).get(name) or ""

    def text(self, k: int) -> str:
        return " ".join("".join(r[7] or "" for r in self.rows[k : self.rows[k][1] + 1] if r[4] == "text").split())


def _folder(path: str) -> str:
    return path.rpartition("/")[0]


def _points(m: _Markup, of: int, parent: int, depth: int, base: str, out: list[dict]) -> None:
    """Entries below a navMap, navPoint, nav or list item, parents before their children."""
    for k in m.children(of):
        if m.name(k) == "navpoint":
            label = next((m.text(i) for i in m.children(k) if m.name(i) == "navlabel"), "")
            href = next((m.get(i, "src") for i in m.children(k) if m.name(i) == "content"), "")
        elif m.name(k) == "li":
            own = [i for i in m.children(k) if m.name(i) in ("a", "span")]
            link = next((i for i in own if m.name(i) == "a"), own[0] if own else None)
            label, href = (m.text(link), m.get(link, "href")) if link is not None else ("", "")
        elif m.name(k) == "ol":
            _points(m, k, parent, depth, base, out)
            continue
        else:
            continue
        out.append({"kind": "toc", "ord": len(out), "parent": parent, "depth": depth, "label": label, "href": resolved(href, base) if href else None})
        _points(m, k, len(out) - 1, depth + 1, base, out)


def _navs(m: _Markup, kind: str) -> list[int]:
    return [k for k in m.inside(None, "nav") if kind in m.get(k, "epub:type").split()]


def package(raw: bytes | None) -> list[dict]:
    """The rows of one file."""
    try:
        files = zipfile.ZipFile(io.BytesIO(raw or b""))
        box = _Markup(files.read("META-INF/container.xml"))
        root = next((unquote(box.get(k, "full-path")) for k in box.inside(None, "rootfile") if box.get(k, "full-path")), "")
        opf = _Markup(files.read(root))
    except (zipfile.BadZipFile, KeyError):
        return []
    base, out = _folder(root), []
    for part in opf.inside(None, "metadata")[:1]:
        seen: set[str] = set()
        for k in opf.children(part):
            name = opf.name(k)
            if opf.rows[k][5].startswith("dc:") and name not in seen:
                seen.add(name)
                if label := opf.text(k):
                    out.append({"kind": "metadata", "ord": len(out), "id": name, "label": label})
    manifest: dict[str, dict] = {}
    for part in opf.inside(None, "manifest")[:1]:
        for k in opf.inside(part, "item"):
            if opf.get(k, "id") and opf.get(k, "href"):
                manifest[opf.get(k, "id")] = {
                    "kind": "manifest", "id": opf.get(k, "id"), "href": resolved(opf.get(k, "href"), base),
                    "media_type": opf.get(k, "media-type"), "properties": opf.get(k, "properties"),
                }
    out += [x | {"ord": i} for i, x in enumerate(manifest.values())]
    toc_id = ""
    for part in opf.inside(None, "spine")[:1]:
        toc_id = opf.get(part, "toc")
        refs = [k for k in opf.children(part) if opf.name(k) == "itemref" and opf.get(k, "idref")]
        out += [{"kind": "spine", "ord": i, "id": opf.get(k, "idref"), "linear": opf.get(k, "linear") != "no", "href": manifest.get(opf.get(k, "idref"), {}).get("href")} for i, k in enumerate(refs)]
    nav = next((x["href"] for x in manifest.values() if "nav" in x["properties"].split()), None)
    path = nav or manifest.get(toc_id, {}).get("href")
    if not path or path not in files.namelist():
        return out
    m, toc, places = _Markup(files.read(path)), [], []
    if nav:
        for k in (_navs(m, "toc") or m.inside(None, "nav"))[:1]:
            _points(m, k, -1, 0, _folder(path), toc)
        places = [(m.text(i), m.get(i, "href")) for k in _navs(m, "page-list")[:1] for i in m.inside(k, "a")]
    else:
        for k in m.inside(None, "navmap")[:1]:
            _points(m, k, -1, 0, _folder(path), toc)
        for k in m.inside(None, "pagetarget"):
            src = [m.get(i, "src") for i in m.inside(k, "content")]
            places.append((" ".join(m.text(i) for i in m.inside(k, "navlabel")), src[0] if src else ""))
    places = [x for x in places if all(x)]
    return out + toc + [{"kind": "page_list", "ord": i, "label": a, "href": resolved(b, _folder(path))} for i, (a, b) in enumerate(places)]


def packages(books: DataFrame) -> DataFrame:
    """Package rows of a table doc_id, bytes. parent is the ord of the parent entry in the table of contents, -1 at the top."""

    return by_row(books.select("doc_id", "bytes"), lambda doc_id, raw: ((doc_id, *map(x.get, COLUMNS[1:])) for x in package(raw)), SCHEMA)


def packed(pages: DataFrame) -> DataFrame:
    """doc_id, bytes: an EPUB file of one section for each row of doc_id, title, label (of its entry in the contents), html."""
    from xml.sax.saxutils import escape

    def pack(doc_id, title, label, html) -> bytes:
        place, raw = f"text/{doc_id}.xhtml", io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
            z.writestr("OEBPS/book.opf", f'<package><metadata><dc:title>{escape(title or "")}</dc:title></metadata><manifest><item id="s" href="{place}" media-type="application/xhtml+xml"/>'
                       '<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="s"/></spine></package>')
            z.writestr("OEBPS/nav.xhtml", f'<html><body><nav epub:type="toc"><ol><li><a href="{place}">{escape(label or "")}</a></li></ol></nav></body></html>')
            z.writestr(f"OEBPS/{place}", html or "")
        return raw.getvalue()

    return by_row(pages.select("doc_id", "title", "label", "html"), lambda *page: [(page[0], pack(*page))], "doc_id long, bytes binary")
