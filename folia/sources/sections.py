"""The sections of EPUB files as flat rows: blocks, ids, inner links and page markers, each with its top-level block.

A book's file is read whole by one batch function; offsets, notes and the contents' places are joins over its rows.
Files that can't be read, spine items without a readable page and pages without a body give only their section row.
"""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.operators.blocks import Block, Converter, Span, book_type
from folia.sources.by_row import by_row
from folia.sources.epub import _Markup, package
from folia.sources.html import tree
from folia.sources.page_index import PageIndex

SCHEMA = "doc_id long, spine int, kind string, block int, ord int, name string, type string, role string, cfi string, text string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

# Page media types, roles of note references.
PAGE_TYPES = {"", "application/xhtml+xml", "text/html", "application/html"}
NOTE_ROLES = ("doc-noteref", "doc-biblioref", "doc-glossref")


def steps(page: PageIndex, k: int) -> str:
    """The path of a node below the root element as fragment steps: even for elements, odd for text. Elements that a
    reader takes out (styles, titles, style sheet links) don't count."""

    def counts(c: int) -> bool:
        out = page.tag[c] in {"style", "title"} or (page.tag[c] == "link" and re.search(r"\bstylesheet\b", page.attrs[c].get("rel", ""), re.I))
        return bool(page.tag[c]) and not out

    path = []
    while page.parent[k] >= 0:
        before = sum(counts(c) for c in page.kids[page.parent[k]] if c < k)
        path.append(2 * before + (2 if page.tag[k] else 1))
        k = page.parent[k]
    return "".join(f"/{n}" for n in reversed(path))


def markers(page: PageIndex, k: int) -> list[tuple[str, str]]:
    """(source, label) of the page marks that an element shows."""
    a, out = page.attrs[k], []
    name = a.get("id", "")
    if re.search("page", name, re.I) and name.lower() not in {"pagetop", "pagebottom"}:
        label = re.sub("^(.*_)+", "", re.sub("page[-_]?", "", name, count=1, flags=re.I))
        out += [(source, label) for source in (["id"] if page.kids[k] else ["id-empty", "id"]) if label]
    if "pagebreak" in book_type(a) and a.get("title"):
        out.append(("type", a["title"]))
    if a.get("role") == "doc-pagebreak" and (label := a.get("aria-label") or a.get("title")):
        out.append(("role", label))
    return out


def nested_text(block: Block) -> str:
    return "".join(s.text for s in block.content) if block.content and isinstance(block.content[0], Span) else "\n".join(nested_text(b) for b in block.content)


def section(html: str, base: str) -> list[dict]:
    """The rows of one page; base: the fragment identifier's part for the spine item."""
    page = PageIndex(tree(html))
    if page.body is None:
        return []
    made = Converter(page, notes=True)
    blocks = made.blocks(page.body)
    ends = [page.last[b.node] if b.end is None else b.end for b in blocks]
    rows = [{"kind": "block", "block": i, "ord": i, "type": b.type, "cfi": f"{base}!{steps(page, b.node)}", "text": nested_text(b)} for i, b in enumerate(blocks)]
    link = dict(made.links)
    done = 0
    for k in sorted(made.seen):
        while done < len(ends) and ends[done] < k:
            done += 1
        a = page.attrs[k]
        if a.get("id"):
            rows.append({"kind": "id", "block": done, "ord": k, "name": a["id"]})
        rows += [{"kind": "marker", "block": done, "ord": k, "name": label, "type": source} for source, label in markers(page, k)]
        if k in link:
            rows.append({"kind": "link", "block": done, "ord": k, "name": link[k], "type": " ".join(book_type(a)), "role": a.get("role")})
    return rows


def sections_of(raw: bytes | None) -> list[dict]:
    rows = package(raw)
    media = {r["id"]: r["media_type"] for r in rows if r["kind"] == "manifest"}
    spine = [r for r in rows if r["kind"] == "spine"]
    if not spine:
        return []
    files = zipfile.ZipFile(io.BytesIO(raw))
    box = _Markup(files.read("META-INF/container.xml"))
    from urllib.parse import unquote

    opf = _Markup(files.read(next(unquote(box.get(k, "full-path")) for k in box.inside(None, "rootfile") if box.get(k, "full-path"))))
    root = next(iter(opf.inside(None, "package")), None)
    kin = [opf.name(k) for k in opf.children(root)] if root is not None else []
    step = 2 * (kin.index("spine") + 1) if "spine" in kin else 6
    held, out = set(files.namelist()), []
    for r in spine:
        i, path = r["ord"], r["href"]
        out.append({"spine": i, "kind": "section", "name": path})
        if path in held and media.get(r["id"], "") in PAGE_TYPES:
            out += [{"spine": i} | x for x in section(files.read(path).decode("utf-8", "replace"), f"/{step}/{2 * (i + 1)}")]
    return out


def sections(books: DataFrame) -> DataFrame:
    """Rows of a table doc_id, bytes; see SCHEMA. name: path, id, label or link; type: block type, marker source or link type."""

    return by_row(books.select("doc_id", "bytes"), lambda doc_id, raw: ((doc_id, *map(x.get, COLUMNS[1:])) for x in sections_of(raw)), SCHEMA)


# All windows below stand on a book or parts of it: a book's rows are read once and go through one exchange.


def _start(order: str = "spine"):
    """The number of blocks in the book before the spine item."""
    before = Window.partitionBy("doc_id").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.count_if(F.col("kind") == "block").over(before), F.lit(0))


def with_offsets(rows: DataFrame) -> DataFrame:
    """rows with `place`: the block's number in the whole book."""
    known = rows.filter("doc_id is not null and spine is not null")
    return known.withColumn("place", _start() + F.coalesce("block", F.lit(0)))


def _last_id(name: str):
    """The last row with an id of the book among those that share the column: its spine, ord, block and place."""
    return F.max(F.when((F.col("kind") == "id") & F.col("name").isNotNull(), F.struct("spine", "ord", "block", "place"))).over(Window.partitionBy("doc_id", name))


def _last_file(name: str):
    """The last spine item (spine, place) among those that share the column."""
    return F.max(F.when((F.col("kind") == "section") & F.col("name").isNotNull(), F.struct("spine", "place"))).over(Window.partitionBy("doc_id", name))


def _by_file(rows: DataFrame, path) -> DataFrame:
    """rows with `file`: the path of spine items, and again their bare name; path for others."""
    names = F.array_distinct(F.array("name", F.element_at(F.split("name", "/"), -1)))
    return rows.withColumn("file", F.explode(F.when((F.col("kind") == "section") & F.col("name").isNotNull(), names).otherwise(F.array(path))))


def _decoded(path):
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def note_links(rows: DataFrame) -> DataFrame:
    """doc_id, source, target (places in the book), back (all sources of the target): links to notes. A link counts by
    its type, else by its role, else if it leads to a note block; one whose file isn't the id's leads nowhere."""
    x = with_offsets(rows.select("doc_id", "spine", "kind", "block", "ord", "name", "type", "role"))
    is_link, is_block = F.col("kind") == "link", F.col("kind") == "block"
    x = x.filter("kind in ('block', 'id', 'section') or kind = 'link' and name like '%#_%'")
    x = x.withColumn("path", F.when(is_link, F.regexp_extract("name", "^([^#]*)#", 1)))
    x = x.withColumn("fragment", F.when(is_link, F.regexp_extract("name", "^[^#]*#(.*)$", 1)).when(F.col("kind") == "id", F.col("name")))
    x = x.withColumn("id", _last_id("fragment")).filter(~is_link | F.col("id").isNotNull())
    x = _by_file(x, F.col("path")).withColumn("file_spine", _last_file("file")["spine"])
    x = x.withColumn("plain", F.when(is_link, _decoded(F.col("path"))).otherwise(F.col("file"))).withColumn("plain_spine", _last_file("plain")["spine"])
    spine = F.coalesce("file_spine", "plain_spine")
    x = x.filter(is_block | (is_link & ((F.col("path") == "") | spine.isNull() | (spine == F.col("id.spine")))))
    x = x.withColumn("source", F.col("place")).withColumn("target", F.when(is_block, F.col("place")).otherwise(F.col("id.place")))
    x = x.withColumn("end", F.max(F.when(is_block, F.struct("type"))).over(Window.partitionBy("doc_id", "target")))
    x = x.withColumn("begun", F.max(is_block).over(Window.partitionBy("doc_id", "source")))
    x = x.filter(is_link & F.col("end").isNotNull() & F.col("begun"))
    note = F.when(F.array_contains(F.split("type", " "), "noteref"), True).when(F.col("role") == "doc-link", False).when(F.col("role").isin(*NOTE_ROLES), True).otherwise(F.col("end.type") == "note")
    return x.filter(note).select("doc_id", "source", "target").withColumn("back", F.array_sort(F.collect_list("source").over(Window.partitionBy("doc_id", "target"))))


def contents_places(packages: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, ord, parent, label, place of the contents' entries: the fragment's block, else the section's start; none
    for files outside the spine and unknown fragments."""
    return _placed_entries(packages.filter("kind = 'toc'"), rows)


def page_list_places(packages: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, ord, label, place of the page list's entries that lead into the book, in order."""
    return _placed_entries(packages.filter("kind = 'page_list'"), rows).drop("parent").filter("place is not null")


def marker_places(rows: DataFrame) -> DataFrame:
    """doc_id, source, ord, label, place of the page markers in the text, by the kind of their source."""
    return with_offsets(rows).filter("kind = 'marker'").select("doc_id", F.col("type").alias("source"), "spine", "ord", F.col("name").alias("label"), "place")


def _placed_entries(entries: DataFrame, rows: DataFrame) -> DataFrame:
    toc = entries.select("doc_id", F.lit("entry").alias("kind"), "ord", "parent", "label", F.regexp_extract("href", "^[^#]*", 0).alias("path"), F.nullif(F.regexp_extract("href", "#(.*)$", 1), F.lit("")).alias("fragment"))
    known = rows.filter("doc_id is not null and spine is not null and kind in ('block', 'id', 'section')").select("doc_id", "spine", "kind", "block", "ord", "name")
    is_entry = F.col("kind") == "entry"
    x = known.unionByName(toc, allowMissingColumns=True).withColumn("place", _start() + F.coalesce("block", F.lit(0))).filter("kind <> 'block'")
    x = _by_file(x, F.col("path")).withColumn("start", _last_file("file")["place"]).filter("kind <> 'section'")
    x = x.withColumn("id_name", F.when(is_entry, F.col("fragment")).otherwise(F.col("name"))).withColumn("target", _last_id("id_name")["place"])
    x = x.withColumn("plain", F.when(is_entry, _decoded(F.col("fragment"))).otherwise(F.col("name"))).withColumn("plain_target", _last_id("plain")["place"])
    place = F.when(F.col("start").isNull(), None).when(F.col("fragment").isNull(), F.col("start")).otherwise(F.coalesce("target", "plain_target"))
    return x.filter(is_entry).select("doc_id", "ord", "parent", "label", place.alias("place"))
