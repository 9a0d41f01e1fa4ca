"""Links of documents: from annotations, from addresses in the text, and the places that they lead to.

Character rows have: doc_id, block, pos (place in the block's text), page_index, x1, y1, x2, y2. Block rows have:
doc_id, block, type, text. Offsets count from 0, ends are inclusive.

Edge cases. Null urls, texts and rectangles give no links. Blocks without text give none. Equal rows are links of their
own. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.scalars import chebyshev_gap

from .characters import BOX

# The forms of web addresses and of document identifiers.
ADDRESS = r"(?:https?://|www\.)[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b[-a-zA-Z0-9()@:%_+.~#?&/=]*"
IDENTIFIER = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
RESOLVER = "https://doi.org/"


def of_annotations(annotations: DataFrame) -> DataFrame:
    """The annotations that have a rectangle and an address or a place to lead to; an address comes first."""
    led = F.when(F.coalesce("url", F.lit("")) == "", F.col("dest"))
    return annotations.filter("rect is not null and (coalesce(url, '') <> '' or dest is not null)").withColumn("dest", led)


def resolved(dests: DataFrame, pages: DataFrame) -> DataFrame:
    """dests with dest_page and the point x, y that they lead to, within the page. dests: doc_id, page, kind, args (up to
    four numbers, null for 'as it is'); pages: doc_id, page_index, view, rotate. Unknown kinds and pages are left out."""
    p = pages.select(F.col("doc_id").alias("__doc"), F.col("page_index").alias("__page"), "view", "rotate")
    x = dests.join(p, (dests["doc_id"] == p["__doc"]) & (dests["page"] == p["__page"])).drop("__doc", "__page")
    side = [F.get("view", F.lit(i)) for i in range(4)]
    top = F.when(F.col("rotate") % 180 != 0, side[2] - side[0]).otherwise(side[3] - side[1])
    arg = lambda i, other: F.coalesce(F.get("args", F.lit(i)), other)
    kind, zero = F.col("kind"), F.lit(0.0)
    px = F.when(kind.isin("XYZ", "FitV", "FitBV", "FitR"), arg(0, zero)).when(kind.isin("Fit", "FitB", "FitH", "FitBH"), zero)
    py = F.when(kind == "XYZ", arg(1, top)).when(kind.isin("FitH", "FitBH"), arg(0, top)).when(kind == "FitR", arg(3, top)).when(kind.isin("Fit", "FitB", "FitV", "FitBV"), top)
    within = lambda v, low, high: F.least(F.greatest(v, low), high)
    return x.filter(px.isNotNull()).withColumn("x", within(px, side[0], side[2])).withColumn("y", within(py, side[1], side[3])).withColumn("dest_page", F.col("page")).drop("view", "rotate")


def same_target(a: Column, b: Column) -> Column:
    """Whether two links (struct of url, page, x, y) lead to the same place."""
    outer = a["url"].isNotNull() & b["url"].isNotNull() & (a["url"] == b["url"])
    place = lambda s: F.struct(s["page"], s["x"], s["y"])
    return F.coalesce(outer | (a["url"].isNull() & b["url"].isNull() & (place(a) == place(b))), F.lit(False))


def under(links: DataFrame, chars: DataFrame) -> DataFrame:
    """id, block, start, end: the one run of a block's characters whose centres lie in a link's rectangle. A gap in it
    makes it none; characters on other pages end a run, and the last run counts. links: id, doc_id, page_index, rect."""
    from pyspark.sql import Window

    off = links.select("id", F.col("doc_id").alias("__doc"), F.col("page_index").alias("__page"), *[F.get("rect", F.lit(i)).alias(f"__r{i}") for i in range(4)])
    # a change of page within a block begins a new segment
    w = Window.partitionBy("doc_id", "block").orderBy("pos")
    turned = F.coalesce((F.lag("page_index").over(w) != F.col("page_index")).cast("int"), F.lit(0))
    seg = chars.withColumn("__turn", turned).withColumn("__seg", F.sum("__turn").over(w))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    on = (seg["doc_id"] == off["__doc"]) & (seg["page_index"] == off["__page"]) & (cx >= off["__r0"]) & (cx <= off["__r2"]) & (cy >= off["__r1"]) & (cy <= off["__r3"])
    runs = off.join(seg, on).groupBy("id", "doc_id", "block", "__seg").agg(F.min("pos").alias("s"), F.max("pos").alias("e"), F.count(F.lit(1)).alias("n"))
    whole = F.bool_and(F.col("e") - F.col("s") + 1 == F.col("n"))
    last = runs.groupBy("id", "doc_id", "block").agg(whole.alias("whole"), F.max(F.struct("__seg", "s", "e")).alias("x")).filter("whole")
    return last.select("id", "doc_id", "block", F.col("x.s").alias("start"), F.col("x.e").alias("end"))


def destination(asked: DataFrame, blocks: DataFrame, chars: DataFrame) -> DataFrame:
    """id, block, start, end: the first place of a link's own text in a block on the page that it leads to, headings
    before others, then the nearest to the point, then the first block. asked: id, doc_id, text, dest_page, x, y."""
    on_page = chars.select("doc_id", "page_index", "block").distinct().join(blocks, ["doc_id", "block"])
    a = asked.filter("text <> ''").select("id", F.col("doc_id").alias("__doc"), F.col("text").alias("__text"), "dest_page", "x", "y")
    hit = a.join(on_page, (on_page["doc_id"] == a["__doc"]) & (on_page["page_index"] == a["dest_page"]) & F.contains(on_page["text"], a["__text"]))
    hit = hit.withColumn("start", F.instr("text", F.col("__text")) - 1).withColumn("end", F.col("start") + F.char_length("__text") - 1)
    hit = hit.select("id", "doc_id", "block", "dest_page", "x", "y", "start", "end", (F.col("type") != "heading").alias("plain"))
    c = chars.select(F.col("doc_id").alias("__doc"), F.col("block").alias("__block"), "page_index", "pos", *BOX)
    near = hit.join(c, (c["__doc"] == hit["doc_id"]) & (c["__block"] == hit["block"]) & (c["page_index"] == hit["dest_page"]) & c["pos"].between(hit["start"], hit["end"]), "left")
    gap = chebyshev_gap([F.col("x"), F.col("y"), F.col("x"), F.col("y")], [F.col(n) for n in BOX])
    measured = near.groupBy("id", "block", "start", "end", "plain").agg(F.min(gap).alias("gap")).filter("not plain or gap is not null")
    best = F.min(F.struct("plain", F.coalesce("gap", F.lit(float("inf"))).alias("gap"), "block", "start", "end"))
    return measured.groupBy("id").agg(best.alias("b")).select("id", "b.block", "b.start", "b.end")


def without_tail(found: Column) -> Column:
    """An address without closing punctuation and without a last ')' that has no '('."""
    extra = lambda s: F.endswith(s, F.lit(")")) & (F.regexp_count(s, F.lit(r"\)")) > F.regexp_count(s, F.lit(r"\(")))
    # each step takes all closing punctuation and then one bracket; a text has at most as many steps as brackets
    steps = F.sequence(F.lit(0), F.regexp_count(found, F.lit(r"\)")))
    bare = lambda s: F.regexp_replace(s, r"[,.;:!?\]}]+$", "")
    return F.aggregate(steps, bare(found), lambda s, _: F.when(extra(s), bare(F.substring(s, F.lit(1), F.char_length(s) - 1))).otherwise(s))


def _matches(text: Column, form: str) -> Column:
    """start and raw text of every match: the lengths of what stands between the matches give their places."""
    found, between = F.regexp_extract_all(text, F.lit(f"({form})"), F.lit(1)), F.split(text, form, -1)
    upto = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda t, x: t + F.char_length(x))
    return F.transform(found, lambda x, i: F.struct((upto(between, i + 1) + upto(found, i)).alias("start"), x.alias("raw")))


def parsed(blocks: DataFrame) -> DataFrame:
    """doc_id, block, start, end, url: every address in the blocks' texts but those with an '@', and every identifier
    that doesn't lie in one of them, as an address of its resolver. Preformatted blocks and those marked monospace are
    left out."""
    plain = blocks.filter(F.coalesce(F.col("type") != "preformatted", F.lit(True)) & (F.coalesce("text", F.lit("")) != ""))
    span = lambda s, url, shown: F.struct(s.alias("start"), (s + F.char_length(url) - 1).alias("end"), shown.alias("url"))
    web = F.transform(F.filter(_matches(F.col("text"), ADDRESS), lambda m: ~F.contains(m["raw"], F.lit("@"))), lambda m: span(m["start"], without_tail(m["raw"]), without_tail(m["raw"])))
    x = plain.select("doc_id", "block", "text", F.filter(web, lambda m: m["url"] != "").alias("web"))
    encoded = lambda s: F.replace(F.replace(F.url_encode(s), F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")"))
    ids = F.transform(_matches(F.col("text"), IDENTIFIER), lambda m: span(m["start"], without_tail(m["raw"]), F.concat(F.lit(RESOLVER), encoded(without_tail(m["raw"])))))
    free = F.filter(ids, lambda m: (m["end"] >= m["start"]) & ~F.exists("web", lambda o: (o["start"] <= m["end"]) & (m["start"] <= o["end"])))
    return x.select("doc_id", "block", F.explode(F.concat("web", free)).alias("m")).select("doc_id", "block", "m.start", "m.end", "m.url")


def added(existing: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, block, ord, start, end: new ranges, in the order of ord, that meet neither an existing range of their
    block nor one that was added before them."""
    span = F.struct("start", "end")
    old = existing.groupBy("doc_id", "block").agg(F.collect_list(span).alias("old"))
    rows = new.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end"))).alias("new")).join(old, ["doc_id", "block"], "left")
    meets = lambda kept, x: F.exists(kept, lambda o: (o["start"] <= x["end"]) & (x["start"] <= o["end"]))
    free = F.filter("new", lambda x: ~F.coalesce(meets(F.col("old"), x), F.lit(False)))
    kept = F.aggregate(free, F.slice("new", 1, 0), lambda acc, x: F.when(meets(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("doc_id", "block", F.explode(kept).alias("x")).select("doc_id", "block", "x.ord", "x.start", "x.end")
