"""Queries of laid-out pages: raw annotations, characters, links, flow, line features, text nodes; with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.operators import annotation_import as AI
from folia.operators import characters as CH
from folia.operators import documents as DO
from folia.operators import dom
from folia.operators import flow as FL
from folia.operators import line_features as LF
from folia.operators import links as LK
from folia.operators import nodes as N
from folia.operators import raw_annotations as RA
from folia.operators import sequences as Q
from folia.operators import text_layer as T
from folia.sources import epub as E
from folia.sources.html import dom_nodes

from .registry import _query, _t

_NUMBERED = """ln AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS n FROM lineitem)"""


def _numbered(spark, d):
    """Lineitem with n, a number of its own within the order from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return Q.dealt(li, "l_orderkey").withColumn("n", F.row_number().over(w))


# Raw annotations, made of lineitem

_PREFIX = "Own-"
_RAW = """raw AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_linenumber % 3 AS page_index, l_partkey AS p,
    ['Text', 'Highlight', 'Underline', 'Square', 'Ink', 'FreeText', 'Popup'][l_partkey % 7 + 1] AS subtype,
    CASE WHEN l_suppkey % 3 = 0 THEN 'K' || l_partkey WHEN l_suppkey % 3 = 1 THEN CAST(l_partkey AS VARCHAR) END AS id,
    CAST(l_partkey % 500 AS DOUBLE) + 0.1235 AS x1, CAST(l_suppkey % 700 AS DOUBLE) + 0.5 AS y1, CAST(l_partkey % 500 AS DOUBLE) + 0.1235 + l_quantity AS x2, CAST(l_suppkey % 700 AS DOUBLE) + 10.5 AS y2,
    l_quantity AS q FROM lineitem)"""


def _raw(spark, d):
    x1, y1 = (F.col("l_partkey") % 500).cast("double") + 0.1235, (F.col("l_suppkey") % 700).cast("double") + 0.5
    x2, y2 = x1 + F.col("l_quantity"), y1 + 10.0
    p, n, s = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
    pick = lambda i, values: F.get(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), i.cast("int"))
    turned = F.when(n % 2 == 0, F.array(x2, y1, x1, y2)).otherwise(F.array(x1, y1, x2, y2))
    quad = lambda dy: [x1, y2 - dy, x2, y2 - dy, x1, y1 - dy, x2, y1 - dy]
    none = F.lit(None)
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), n.alias("ord"), (n % 3).alias("page_index"), pick(p % 7, ["Text", "Highlight", "Underline", "Square", "Ink", "FreeText", "Popup"]).alias("subtype"),
        F.when(s % 3 == 0, F.concat(F.lit("K"), p.cast("string"))).otherwise("").alias("key"), F.when(s % 3 == 1, F.concat(F.lit(_PREFIX), p.cast("string"))).otherwise("x").alias("name"),
        turned.alias("rect"), F.when((p % 5 != 0) & (p % 7 != 0), F.array(*quad(0.0), *quad(-20.0))).alias("quads"), F.array(F.array(x1, y1, x2, y2), F.array(x1, y2)).alias("paths"),
        F.when(p % 11 != 0, F.col("l_quantity") / 7).alias("border_width"), (p % 800 - 400).cast("double").alias("rotation"), (F.col("l_quantity") + 0.26).alias("font_size"), turned.alias("text_rect"),
        pick(n % 3, ["D:20190429115637", "D:2020", "none"]).alias("modified"), F.lit("A").alias("author"), F.when(n % 2 == 0, "note").alias("contents"),
        F.when(p % 4 == 0, F.array().cast("array<double>")).when(p % 4 == 1, F.array(F.lit(0.5))).when(p % 4 == 2, F.array(F.lit(1.0), F.lit(0.25), F.lit(0.125))).otherwise(none).alias("colour"),
        F.when(n % 2 == 1, F.lit(0.5)).alias("alpha"), pick(s % 3, ['["a","b"]', '["a",1]', "x"]).alias("tags"), F.when(n > 1, F.lit(1)).cast("long").alias("parent"),
        F.array(*[F.lit(v) for v in (0.0, 0.0, 500.0, 700.0)]).alias("media_box"), F.array(*[F.lit(v) for v in (0.0, 0.0, 480.0, 900.0)]).alias("crop_box"),
    )


@_query("WITH " + _RAW + """, m AS (SELECT *, round((x1 + x2) / 2, 9) AS cx, y1 + 5 AS cy FROM raw),
n AS (SELECT *, CASE WHEN cx - 11 < 0 THEN 0.0 ELSE cx - 11 END AS nx1, CASE WHEN cx - 11 < 0 THEN 22.0 ELSE cx + 11 END AS nx2, CASE WHEN cy - 11 < 0 THEN 0.0 ELSE cy - 11 END AS ny1, CASE WHEN cy - 11 < 0 THEN 22.0 ELSE cy + 11 END AS ny2 FROM m),
r AS (SELECT *, CASE WHEN nx2 > 480 THEN 458.0 ELSE nx1 END AS fx1, CASE WHEN nx2 > 480 THEN 480.0 ELSE nx2 END AS fx2, CASE WHEN ny2 > 700 THEN 678.0 ELSE ny1 END AS fy1, CASE WHEN ny2 > 700 THEN 700.0 ELSE ny2 END AS fy2 FROM n),
t AS (SELECT doc_id, ord, page_index, id, CASE subtype WHEN 'Text' THEN 'note' WHEN 'Square' THEN 'image' WHEN 'FreeText' THEN 'text' ELSE lower(subtype) END AS type, p, q, x1, y1, x2, y2, fx1, fy1, fx2, fy2 FROM r
    WHERE subtype <> 'Popup' AND (subtype IN ('Text', 'Highlight', 'Underline') OR id IS NOT NULL) AND (subtype <> 'Ink' OR p % 11 <> 0))
SELECT doc_id, ord, page_index, id, type, CAST(CASE WHEN type = 'ink' THEN NULL WHEN type IN ('highlight', 'underline', 'image') AND p % 5 <> 0 THEN 2 ELSE 1 END AS INTEGER) AS n_rects,
    CASE type WHEN 'ink' THEN NULL WHEN 'note' THEN floor(fx1 * 1000 + 0.5) / 1000 WHEN 'text' THEN x1 ELSE floor(x1 * 1000 + 0.5) / 1000 END AS x1,
    CASE type WHEN 'ink' THEN NULL WHEN 'note' THEN floor(fy1 * 1000 + 0.5) / 1000 WHEN 'text' THEN y1 ELSE y1 + CASE WHEN p % 5 <> 0 THEN 20 ELSE 0 END END AS y1,
    CASE type WHEN 'ink' THEN NULL WHEN 'note' THEN floor(fx2 * 1000 + 0.5) / 1000 WHEN 'text' THEN x2 ELSE floor(x2 * 1000 + 0.5) / 1000 END AS x2,
    CASE WHEN type = 'ink' THEN 6 END AS n_points, CASE WHEN type = 'ink' THEN floor(q / 7 * 1000 + 0.5) / 1000 END AS width,
    CASE WHEN type = 'text' THEN CAST(((p % 800 - 400) + 720) % 360 AS DOUBLE) END AS rotation, CASE WHEN type = 'text' THEN floor((q + 0.26) * 10 + 0.5) / 10 END AS font_size,
    CASE ord % 3 WHEN 0 THEN '2019-04-29 11:56:37' WHEN 1 THEN '2020-01-01 00:00:00' ELSE '1999-12-31 23:59:59' END AS modified, CASE WHEN ord % 2 = 0 THEN 'note' ELSE '' END AS comment,
    CASE WHEN p % 4 = 0 THEN '' WHEN p % 4 = 1 THEN CASE WHEN ord % 2 = 1 THEN '#c0c0c0' ELSE '#808080' END WHEN p % 4 = 2 THEN CASE WHEN ord % 2 = 1 THEN '#ffa090' ELSE '#ff4020' END ELSE CASE WHEN ord % 2 = 1 THEN '#808080' ELSE '#000000' END END AS colour
FROM t""")
def raw_annotations_read(spark, d):
    """Six types of raw annotations with validity, own ids, geometry, dates and colours; notes' centres to nine places,
    as the twin has them: many lie on ties of the third place."""
    x = RA.read(_raw(spark, d), _PREFIX, F.lit("1999-12-31 23:59:59").cast("timestamp"), centre_places=9)
    first = lambda i: F.get(F.get("rects", F.lit(0)), F.lit(i))
    return x.select(
        "doc_id", "ord", "page_index", "id", "type", F.size("rects").alias("n_rects"), first(0).alias("x1"), first(1).alias("y1"), first(2).alias("x2"),
        F.size(F.flatten("paths")).alias("n_points"), "width", "rotation", "font_size", F.date_format("date_modified", "yyyy-MM-dd HH:mm:ss").alias("modified"), "comment", "colour",
    )


@_query("SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_suppkey % 3 = 0 THEN 'a,b' ELSE '' END AS tags FROM lineitem WHERE l_partkey % 7 IN (0, 1, 2)")
def annotation_tags(spark, d):
    x = RA.read(_raw(spark, d).filter(F.col("subtype").isin("Text", "Highlight", "Underline")), _PREFIX, F.current_timestamp())
    return x.select("doc_id", "ord", F.array_join("tags", ",").alias("tags"))


@_query("SELECT l_orderkey AS doc_id, bool_or(l_partkey % 7 < 6) AS marked FROM lineitem GROUP BY ALL")
def annotations_any(spark, d):
    return RA.with_markup(_raw(spark, d))


@_query("WITH " + _RAW + """, g AS (SELECT *, subtype IN ('Text', 'Highlight', 'Underline') OR (subtype IN ('Square', 'Ink', 'FreeText') AND id IS NOT NULL) AS goes FROM raw)
SELECT doc_id, ord, subtype FROM g WHERE NOT goes AND NOT (subtype = 'Popup' AND ord > 1 AND EXISTS (SELECT 1 FROM g p WHERE p.doc_id = g.doc_id AND p.ord = 1 AND p.goes))""")
def annotations_without_transferable(spark, d):
    return RA.without_transferable(_raw(spark, d), _PREFIX).select("doc_id", "ord", "subtype")


@_query("""SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_partkey % 7 = 4 THEN 'ink' ELSE 'highlight' END || CAST(l_linenumber % 3 AS VARCHAR) ||
    CASE WHEN l_partkey % 7 = 4 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END || '[[' || CAST(l_partkey % 500 AS VARCHAR) || ',' || CAST(l_suppkey AS VARCHAR) || '.5]]' || 'c' AS key FROM lineitem""")
def annotation_keys(spark, d):
    ink = F.col("l_partkey") % 7 == 4
    place = F.array(F.array((F.col("l_partkey") % 500).cast("double"), F.col("l_suppkey") + 0.5))
    x = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.when(ink, "ink").otherwise("highlight").alias("type"), "l_quantity", place.alias("place"))
    return x.select("doc_id", "ord", RA.key_text(F.col("type"), F.col("ord") % 3, F.col("place"), F.col("place"), F.col("l_quantity"), F.lit("c")).alias("key"))


@_query("""WITH c AS (SELECT l_suppkey AS doc_id, l_orderkey, l_linenumber, l_partkey % 900 AS x, len('[' || (l_partkey % 900) || ',0,' || (l_partkey % 900 + 10) || ',10]') + 1 AS n FROM lineitem),
s AS (SELECT doc_id, count(*) AS n, sum(n) AS size FROM c GROUP BY doc_id) SELECT doc_id, n AS n_rects, size + 24 >= 4000 AS several FROM s""")
def annotations_split(spark, d):
    """A supplier's lines as rectangles of one annotation, cut where its position gets too long; parts lose no rectangle
    and none is too long."""
    x = (F.col("l_partkey") % 900).cast("double")
    rects = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.array(x, F.lit(0.0), x + 10, F.lit(10.0)).alias("r")))), lambda s: s["r"])
    whole = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(rects.alias("rects"))
    whole = whole.select("doc_id", F.lit(1).alias("page_index"), "rects", F.lit(None).cast("array<array<double>>").alias("paths"), F.lit(None).cast("double").alias("width"))
    parts = RA.split_long(whole, 4000)
    long = F.char_length(RA.position_text(F.col("page_index"), F.col("rects"), F.col("paths"), F.col("width"))) > 4000
    same = parts.groupBy("doc_id").agg(F.sum(F.size("rects")).alias("n_rects"), (F.count(F.lit(1)) > 1).alias("several"), F.bool_or(long).alias("long"))
    return same.filter("not long").drop("long")


@_query("""WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_partkey % 3 = 0 THEN 'Ink' ELSE 'Highlight' END AS subtype, l_partkey % 3 <> 0 AND l_linenumber % 2 = 0 AS pops, l_suppkey % 16 AS c, l_shipdate FROM lineitem),
w AS (SELECT doc_id, ord, subtype, CASE WHEN subtype = 'Highlight' THEN 16 END AS n_quads, CASE WHEN subtype = 'Ink' THEN 10.0 ELSE 5.0 END AS x1, CAST(c * 17 AS DOUBLE) / 255 AS red, strftime(l_shipdate, 'D:%Y%m%d%H%M%SZ00''00''') AS modified FROM a)
SELECT * FROM w UNION ALL SELECT doc_id, ord, 'Popup', NULL, 5.0, NULL, NULL FROM a WHERE pops""")
def annotations_written(spark, d):
    ink = F.col("l_partkey") % 3 == 0
    digit = F.lower(F.hex(F.col("l_suppkey") % 16))
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    x = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("ord"), F.when(ink, "ink").otherwise("highlight").alias("type"),
        F.when(~ink, F.array(array(5, 5, 9, 9), array(6, 1, 8, 2))).alias("rects"), F.when(ink, F.array(array(10, 3, 12, 1), array(11, 9))).alias("paths"),
        F.concat(F.lit("#"), digit, digit, F.lit("0080")).alias("colour"), F.col("l_shipdate").alias("date_modified"), F.when(F.col("l_linenumber") % 2 == 0, "note").otherwise("").alias("comment"),
    )
    return RA.written(x).select(
        "doc_id", "ord", "subtype", F.when(F.col("quads").isNotNull(), F.size("quads")).alias("n_quads"), F.get("rect", F.lit(0)).alias("x1"), F.get("colour", F.lit(0)).alias("red"), "modified"
    )


@_query("WITH " + _NUMBERED + """, p AS (SELECT l_orderkey AS doc_id, n - 1 AS page_index, l_partkey % 3 = 0 AS has_entry, CASE WHEN l_partkey % 2 = 0 THEN 'D' ELSE 'r' END AS style, l_suppkey % 5 + 1 AS start, l_quantity < 10 AS gone FROM ln),
r AS (SELECT *, sum(CASE WHEN has_entry THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_index) AS run FROM p),
f AS (SELECT doc_id, page_index, gone, CASE WHEN run = 0 THEN NULL ELSE first_value(style) OVER x END AS style, CASE WHEN run = 0 THEN 1 ELSE first_value(start) OVER x END + row_number() OVER x - 1 AS start FROM r WINDOW x AS (PARTITION BY doc_id, run ORDER BY page_index)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS new_index FROM f WHERE NOT gone)
SELECT doc_id, min(style) AS first_style, count(*) AS n_pages FROM k WHERE new_index = 0 GROUP BY doc_id""")
def page_labels_regenerated(spark, d):
    """The first label entry of every document after pages were removed."""
    p = _numbered(spark, d).select(F.col("l_orderkey").alias("doc_id"), (F.col("n") - 1).alias("page_index"), (F.col("l_partkey") % 3 == 0).alias("has_entry"), F.when(F.col("l_partkey") % 2 == 0, "D").otherwise("r").alias("s"), (F.col("l_suppkey") % 5 + 1).alias("n"), (F.col("l_quantity") < 10).alias("gone"))
    entry = F.col("has_entry")
    pages = p.select("doc_id", "page_index", "has_entry", F.when(entry, F.col("s")).alias("style"), F.lit(None).cast("string").alias("prefix"), F.when(entry, F.col("n")).alias("start"))
    x = RA.regenerated_labels(pages, p.filter("gone"))
    return x.filter("page_index = 0").groupBy("doc_id").agg(F.min("style").alias("first_style"), F.count(F.lit(1)).alias("n_pages"))


@_query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_partkey % 10 AS target FROM lineitem)
SELECT doc_id, ord, CASE WHEN target IN (3, 7) THEN doc_id % 10 ELSE target END AS target FROM r""")
def references_repointed(spark, d):
    refs = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 10).alias("target"))
    gone = refs.filter("target in (3, 7)").select("doc_id", "target")
    return RA.repointed(refs, gone, refs.select("doc_id", (F.col("doc_id") % 10).alias("other")).distinct())


@_query("""WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST(l_suppkey % 700 AS DOUBLE) AS y1, CAST(l_partkey % 600 AS DOUBLE) + l_quantity AS x2, CAST(l_suppkey % 700 AS DOUBLE) + 4 AS y2 FROM lineitem),
p AS (SELECT *, CASE WHEN x2 - x1 + 20 < 30 THEN (x1 + x2) / 2 - 30 ELSE x1 - 10 END AS a, CASE WHEN x2 - x1 + 20 < 30 THEN (x1 + x2) / 2 + 30 ELSE x2 + 10 END AS c FROM b)
SELECT l_orderkey, l_linenumber, greatest(a, 0) AS x1, greatest(y1 + 2 - 30, 0) AS y1, least(c, 612) AS x2, least(y1 + 2 + 30, 792) AS y2,
    round(least(4.0, sqrt(16777216 / ((least(c, 612) - greatest(a, 0)) * (least(y1 + 2 + 30, 792) - greatest(y1 + 2 - 30, 0))))), 6) AS scale, 2 * greatest(a, 0) AS screen_x FROM p""")
def drawing_boxes(spark, d):
    x, y = (F.col("l_partkey") % 600).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    view = F.array(*[F.lit(v) for v in RA.LETTER])
    path = F.array(F.array(x, y, x + F.col("l_quantity"), y), F.array(x, y + 4))
    b = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", RA.drawn_box(RA.bounding_rect(F.lit(None).cast("array<array<double>>"), path), view).alias("r"))
    at = lambda i: F.get("r", F.lit(i))
    return b.select("l_orderkey", "l_linenumber", at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2"), F.round(RA.raster_scale(F.col("r")), 6).alias("scale"), F.get(RA.on_screen(F.col("r"), view, F.lit(2.0)), F.lit(0)).alias("screen_x"))


# Characters of the benchmark's texts

_ITEM_WORDS = """w0 AS (SELECT item_id AS doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM benchmark),
ws AS (SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS word_no, unnest(ws) AS text FROM w0),
w AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY word_no) AS INTEGER) AS upto FROM ws)"""


def _item_chars(spark, d):
    lines = T.lines(_t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).withColumn("page_index", F.lit(0))
    return CH.placed(lines)


@_query("WITH " + _ITEM_WORDS + """ SELECT doc_id, word_no, text, CAST(upto - length(text) AS INTEGER) AS start, upto - 1 AS "end" FROM w""")
def char_words(spark, d):
    return CH.words(_item_chars(spark, d)).select("doc_id", "word_no", "text", "start", "end")


@_query(r"""WITH b AS (SELECT item_id AS doc_id, string_split(text, chr(10)) AS ls FROM benchmark), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM b), k AS (SELECT * FROM l WHERE trim(line) <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS line_no, trim(regexp_replace(line, ' +', ' ', 'g')) AS text, CAST(72 + 6 * (length(line) - length(ltrim(line))) AS DOUBLE) AS x1, CAST(72 + 6 * length(rtrim(line)) AS DOUBLE) AS x2 FROM k""")
def char_lines(spark, d):
    return CH.lines(_item_chars(spark, d)).select("doc_id", "line_no", "text", "x1", "x2")


@_query("WITH " + _ITEM_WORDS + """ SELECT a.doc_id AS id, string_agg(b.text, ' ' ORDER BY b.word_no) AS text FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.word_no BETWEEN 1 AND 4 WHERE a.word_no = 4 GROUP BY a.doc_id""")
def char_ranges(spark, d):
    """The text from the second to the fifth word of every item, from the characters between."""
    chars = _item_chars(spark, d)
    w = CH.words(chars)
    asked = w.filter("word_no in (1, 4)").groupBy("doc_id", "page_index").agg(F.min("start").alias("head"), (F.max("end") + 1).alias("anchor"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return CH.ranges(asked.withColumn("id", F.col("doc_id")), chars).select("id", "text")


@_query("WITH " + _ITEM_WORDS + """, c AS (SELECT doc_id AS id, CAST(min(upto - length(text)) AS INTEGER) AS anchor, CAST(max(upto) AS INTEGER) AS head FROM w WHERE word_no BETWEEN 1 AND 2 GROUP BY ALL) SELECT * FROM c""")
def char_highlights(spark, d):
    """Highlights over the second and third word find these words' characters again."""
    chars = _item_chars(spark, d)
    w = CH.words(chars).filter("word_no in (1, 2)").select("doc_id", "start", "end")
    inside = chars.join(w, "doc_id").filter("ord between start and end").groupBy("doc_id", "page_index", "start")
    rects = inside.agg(F.array(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).alias("r")).groupBy("doc_id", "page_index").agg(F.collect_list("r").alias("rects"))
    return CH.highlighted(rects.withColumn("id", F.col("doc_id")), chars).select("id", "anchor", "head")


# Links in texts made of the benchmark's

_LINKED = """b AS (SELECT item_id AS doc_id, 'See https://ex' || item_id || '.org/a_(b)). Or 10.1234/ab.' || item_id || ', www.q' || item_id || '.net/x! again https://ex' || item_id || '.org/a_(b)), not me@x.org http://u@h' || item_id || '.de/ ' || text AS text FROM benchmark)"""


@_query("WITH " + _LINKED + """, u AS (SELECT doc_id, text, unnest(['https://ex' || doc_id || '.org/a_(b)', '10.1234/ab.' || doc_id, 'www.q' || doc_id || '.net/x']) AS raw FROM b),
o AS (SELECT doc_id, raw, strpos(text, raw) - 1 AS start FROM u UNION ALL SELECT doc_id, raw, strpos(text, 'again ' || raw) + 5 AS start FROM u WHERE raw LIKE 'https%')
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + length(raw) - 1 AS INTEGER) AS "end", CASE WHEN raw LIKE '10.%' THEN 'https://doi.org/' || replace(raw, '/', '%2F') ELSE raw END AS url FROM o""")
def text_links(spark, d):
    """Addresses and identifiers at each of their places, with brackets and closing punctuation, without mail addresses."""
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("See https://ex"), i, F.lit(".org/a_(b)). Or 10.1234/ab."), i, F.lit(", www.q"), i, F.lit(".net/x! again https://ex"), i, F.lit(".org/a_(b)), not me@x.org http://u@h"), i, F.lit(".de/ "), F.col("text"))
    blocks = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("block"), F.lit("paragraph").alias("type"), text.alias("text"))
    return LK.parsed(blocks).select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "url")


@_query("WITH " + _ITEM_WORDS + """ SELECT CAST(doc_id AS BIGINT) AS id, CAST(upto - length(text) AS INTEGER) AS start, upto - 1 AS "end" FROM w WHERE word_no = 2""")
def link_text_ranges(spark, d):
    """The characters under a link's rectangle: the third word of every item."""
    chars = _item_chars(spark, d).drop("pos").withColumn("block", F.lit(0)).withColumnRenamed("ord", "pos")
    w = CH.words(_item_chars(spark, d)).filter("word_no = 2").select("doc_id", "start", "end")
    box = chars.join(w, "doc_id").filter("pos between start and end").groupBy("doc_id", "page_index")
    links = box.agg(F.array(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).alias("rect")).withColumn("id", F.col("doc_id"))
    return LK.under(links, chars).select("id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@_query("""WITH k AS (SELECT l_orderkey AS id, l_linenumber, ['XYZ', 'Fit', 'FitH', 'FitBV', 'FitR', 'Other'][l_partkey % 6 + 1] AS kind, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_partkey % 900 AS DOUBLE) END AS a, CAST(l_suppkey % 900 AS DOUBLE) AS b FROM lineitem)
SELECT id, l_linenumber, least(greatest(CASE WHEN kind IN ('XYZ', 'FitBV', 'FitR') THEN coalesce(a, 0) ELSE 0 END, 10), 600) AS x, least(greatest(CASE kind WHEN 'XYZ' THEN b WHEN 'FitH' THEN coalesce(a, 780) WHEN 'FitR' THEN b ELSE 780 END, 20), 800) AS y FROM k WHERE kind <> 'Other'""")
def link_points(spark, d):
    """Destinations of five kinds as points on an upright page."""
    kind = F.get(F.array(*[F.lit(k) for k in ("XYZ", "Fit", "FitH", "FitBV", "FitR", "Other")]), (F.col("l_partkey") % 6).cast("int"))
    a, b = F.when(F.col("l_suppkey") % 2 == 0, (F.col("l_partkey") % 900).cast("double")), (F.col("l_suppkey") % 900).cast("double")
    x = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.lit(1).alias("doc_id"), F.lit(0).alias("page"), kind.alias("kind"), F.array(a, b, F.lit(1.0), b).alias("args"))
    pages = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_index"), F.array(*[F.lit(v) for v in (10.0, 20.0, 600.0, 800.0)]).alias("view"), F.lit(180).alias("rotate"))
    return LK.resolved(x, pages).select("id", "l_linenumber", "x", "y")


@_query("WITH " + _NUMBERED + """, r AS (SELECT l_orderkey AS doc_id, n AS ord, CAST(l_partkey % 60 AS INTEGER) AS s, CAST(l_partkey % 60 + l_quantity AS INTEGER) AS e FROM ln)
SELECT doc_id, ord, s AS start, e AS "end" FROM r n WHERE ord = (SELECT min(ord) FROM r f WHERE f.doc_id = n.doc_id AND f.ord > 1 AND NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = f.doc_id AND o.ord = 1 AND o.s <= f.e AND f.s <= o.e))""")
def links_added_first(spark, d):
    """Ranges added one after the other beside existing ones: of those, the first of every document."""
    r = _numbered(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("block"), F.col("n").alias("ord"), (F.col("l_partkey") % 60).cast("int").alias("start"), (F.col("l_partkey") % 60 + F.col("l_quantity")).cast("int").alias("end"))
    x = LK.added(r.filter("ord = 1"), r.filter("ord > 1"))
    return x.groupBy("doc_id").agg(F.min(F.struct("ord", "start", "end")).alias("x")).select("doc_id", "x.ord", "x.start", "x.end")


# Flow and parts, on the documents' lines

_FLOW = """f AS (SELECT *, length(line) AS n, CASE WHEN line_no % 7 = 3 THEN 'auxiliary' WHEN line_no % 7 = 5 THEN 'excluded' END AS flow, CASE WHEN length(line) % 11 = 0 THEN 'heading' ELSE 'paragraph' END AS type FROM lines WHERE line <> '')"""


def _flow_blocks(spark, d):
    n = F.char_length("line")
    x = T.lines(_t(spark, d, "documents")).filter("line <> ''")
    return x.select(
        "doc_id", F.col("line_no").alias("block"), "page_index", F.when(F.col("line_no") % 7 == 3, "auxiliary").when(F.col("line_no") % 7 == 5, "excluded").alias("flow"),
        F.when(n % 11 == 0, "heading").otherwise("paragraph").alias("type"), F.lit(72.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(500.0).alias("x2"), F.lit(12.0).alias("y2"),
        F.lit(1).alias("line_count"), (n % 3).cast("double").alias("first_indent"), F.substring("line", 2, 1).alias("first_char"), (n % 4).cast("double").alias("last_rag"),
        F.when(n > 1, F.substring("line", -2, 1)).alias("last_char"), (F.col("page_index") % 5 == 4).alias("degraded"),
    )


@_query("WITH {LINES}, " + _FLOW + r""", b AS (SELECT *, sum(CASE WHEN flow IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS bodies FROM f), p AS (SELECT * FROM b WHERE type = 'paragraph' AND flow IS NULL),
q AS (SELECT doc_id, line_no AS block, (page_index = lead(page_index) OVER w OR (lead(page_index) OVER w = page_index + 1 AND page_index % 5 <> 4 AND lead(page_index) OVER w % 5 <> 4))
    AND (regexp_matches(line[-2], '[a-z0-9]') OR (line[-2] = '-' AND regexp_matches(lead(line) OVER w, '^.[a-z]'))) AND n % 4 <= 1 AND lead(n) OVER w % 3 <= 1 AND regexp_matches(lead(line) OVER w, '^.[a-z0-9]') AND lead(bodies) OVER w = bodies + 1 AS next, lead(line_no) OVER w AS after FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, block, after AS next_part FROM q WHERE next""")
def paragraph_part_links(spark, d):
    """Paragraphs that go on in the next one of the body, over blocks of other flow and pages with sound text. The
    characters after the first and before the last stand for the ends, which are capitals and full stops."""
    return FL.paragraph_parts(_flow_blocks(spark, d)).filter("next_part is not null").select("doc_id", "block", "next_part")


@_query("WITH {LINES}, " + _FLOW + """ SELECT doc_id, line_no AS block, flow, CASE WHEN flow = 'excluded' THEN 'body' ELSE type END AS type FROM f""")
def flow_normalized(spark, d):
    return FL.normalized(_flow_blocks(spark, d)).select("doc_id", "block", "flow", "type")


@_query("WITH {LINES}, " + _FLOW + """ SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, min(line_no) AS first, max(line_no) + 1 AS last FROM f GROUP BY ALL""")
def page_block_ranges(spark, d):
    return FL.page_blocks(_flow_blocks(spark, d))


@_query("""WITH t AS (SELECT conv_id AS doc_id, turn, role, text, rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations), i AS (SELECT doc_id, k AS block, k // 3 AS list, k % 3 AS place, text FROM t)
SELECT a.doc_id, a.block, b.block AS next_part FROM i a JOIN i b ON b.doc_id = a.doc_id AND b.block = a.block + 1 WHERE a.block % 2 = 0 AND regexp_matches(b.text, '^.[a-z]')""")
def list_item_part_links(spark, d):
    """Turns in lists of three; every other one ends in a hyphen, and goes on where the next has a small second letter."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    t = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    k = F.rank().over(w.orderBy("turn")) - 1
    i = t.withColumn("block", k.cast("long")).withColumn("list", F.floor(F.col("block") / 3)).withColumn("place", F.col("block") % 3)
    i = i.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "list"))).select(
        "doc_id", "block", "list", "place", "n", F.lit(None).cast("string").alias("flow"), F.lit(0).alias("page_index"), F.lit(False).alias("degraded"),
        F.when(F.col("block") % 2 == 0, "-").otherwise("x").alias("last_char"), F.substring("text", 2, 1).alias("first_char"),
    )
    blocks = i.select("doc_id", F.col("list").alias("block"), "flow").distinct()
    return FL.list_item_parts(i, blocks).filter("next_part is not null").select("doc_id", "block", "next_part")


@_query("WITH " + _NUMBERED + """, b AS (SELECT l_orderkey AS doc_id, n, l_partkey % 4 = 0 AS own FROM ln)
SELECT doc_id, CAST(n AS VARCHAR) AS block, CAST(CASE WHEN own THEN 1 ELSE 2 END AS INTEGER) AS n FROM b""")
def block_rects_inherited(spark, d):
    """Blocks with two children each: their own rectangle, or those of the children."""
    b = _numbered(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("i"), (F.col("l_partkey") % 4 == 0).alias("own"))
    r = lambda x: F.array(F.array(x.cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    top = b.select("doc_id", F.array("i").alias("path"), F.when(F.col("own"), r(F.col("i"))).alias("rects"))
    below = b.select("doc_id", F.explode(F.array(F.array("i", F.lit(0)), F.array("i", F.lit(1)))).alias("path"), r(F.col("i")).alias("rects"))
    return FL.with_page_rects(top.unionByName(below)).filter("block not like '%,%'").select("doc_id", "block", F.size("rects").alias("n"))


# Features of lines and objects

_CLASSED = """c AS (SELECT doc_id, line_no, CASE line_no % 9 WHEN 1 THEN '• ' WHEN 2 THEN '(1.2) ' WHEN 3 THEN 'iv. ' WHEN 4 THEN 'β) ' WHEN 5 THEN '— ' WHEN 6 THEN '«' WHEN 7 THEN 'Figure 3 ' ELSE '' END || 'Word ' || CASE line_no % 5 WHEN 0 THEN 'end.' WHEN 1 THEN 'end-' WHEN 2 THEN 'end)' WHEN 3 THEN 'END' ELSE '7' END AS t FROM lines)"""


@_query("WITH {LINES}, " + _CLASSED + """ SELECT doc_id, line_no, CAST(CASE line_no % 9 WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 3 THEN 7 WHEN 4 THEN 8 WHEN 5 THEN 10 WHEN 6 THEN 11 ELSE 0 END AS INTEGER) AS starts,
    CAST(CASE line_no % 5 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 0 ELSE 2 END AS INTEGER) AS ends, line_no % 9 = 7 OR (line_no % 9 IN (0, 6, 8) AND line_no % 5 = 4) AS caption,
    round(len(list_filter(string_split(t, ''), lambda x: x = upper(x))) / length(t)::DOUBLE + 1e-9, 2) AS upper_share FROM c""")
def line_classes(spark, d):
    n = F.col("line_no")
    start = F.get(F.array(*[F.lit(v) for v in ("", "• ", "(1.2) ", "iv. ", "β) ", "— ", "«", "Figure 3 ", "")]), n % 9)
    end = F.get(F.array(*[F.lit(v) for v in ("end.", "end-", "end)", "END", "7")]), n % 5)
    t = F.concat(start, F.lit("Word "), end)
    return T.lines(_t(spark, d, "documents")).select("doc_id", "line_no", LF.start_class(t).alias("starts"), LF.end_class(t).alias("ends"), LF.is_caption(t).alias("caption"), LF.upper_share(t).alias("upper_share"))


@_query("""WITH t AS (SELECT p_partkey, lower(regexp_extract(p_name, '[A-Za-z]+')) AS a FROM part),
h AS (SELECT p_partkey, a, list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split(a, ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS v FROM t)
SELECT p_partkey, v AS hash, CAST(v % 32768 AS INTEGER) AS bucket FROM h""")
def word_hashes(spark, d):
    """The 32-bit hash of the first word of a part's name, and its bucket."""
    word = F.lower(F.regexp_extract("p_name", "[A-Za-z]+", 0))
    return _t(spark, d, "part").select("p_partkey", LF.fnv1a(word).alias("hash"), F.get(LF.first_hashes(F.col("p_name")), F.lit(0)).alias("bucket"))


@_query("""WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(l_partkey % 97 AS DOUBLE) / 100 + l_quantity / 200 AS perimeter, CAST(l_partkey % 97 AS DOUBLE) / 100 * (l_quantity / 200) AS area FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY perimeter DESC, area DESC, l_orderkey, l_linenumber) AS k FROM s) SELECT l_suppkey, l_orderkey, l_linenumber, round(perimeter, 9) AS perimeter FROM r WHERE k <= 256""")
def objects_largest(spark, d):
    x = _t(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("ord"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("l_partkey") % 97).cast("double").alias("x2"),
        F.col("l_quantity").alias("y2"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"),
    )
    return LF.largest_objects(x, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", F.round("perimeter", 9).alias("perimeter"))


@_query(r"""WITH {LINES} SELECT doc_id, line_no, round(len(regexp_extract_all(line, '\p{L}')) / nullif(length(line), 0)::DOUBLE, 6) AS letters, round(len(regexp_extract_all(line, '\p{Nd}')) / nullif(length(line), 0)::DOUBLE, 6) AS digits,
    round(len(regexp_extract_all(line, '\p{Lu}')) / nullif(length(line), 0)::DOUBLE, 6) AS capitals, CAST(length(line) AS INTEGER) AS n_chars FROM lines WHERE line <> ''""")
def line_shares(spark, d):
    r = LF.line_ratios(F.col("line"))
    return T.lines(_t(spark, d, "documents")).filter("line <> ''").select("doc_id", "line_no", *[r[k].alias(k) for k in ("letters", "digits", "capitals", "n_chars")])


@_query("WITH " + _NUMBERED + """ SELECT l_orderkey, n, coalesce(round(CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY n) - 1 AS DOUBLE) / nullif(count(*) OVER (PARTITION BY l_orderkey) - 1, 0), 6), 0) AS place,
    coalesce(round(CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS DOUBLE) / nullif(count(*) OVER (PARTITION BY l_orderkey) - 1, 0), 6), 0) AS size_place,
    coalesce(CAST(l_partkey AS DOUBLE) - lag(CAST(l_partkey AS DOUBLE)) OVER w, 0) AS left_before, coalesce(l_quantity - lead(l_quantity) OVER w, 0) AS size_after FROM ln WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)""")
def block_context(spark, d):
    """A block's place on its page and its differences to its neighbours."""
    x = _numbered(spark, d).select("l_orderkey", "n", F.col("n").alias("ord"), F.col("l_partkey").cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.lit(9.0).alias("x2"), F.lit(1.0).alias("y2"), F.col("l_quantity").alias("size"))
    x = LF.neighbour_gaps(LF.page_ranks(x, ["l_orderkey"]), ["l_orderkey"])
    return x.select("l_orderkey", "n", "place", "size_place", "left_before", "size_after")


@_query("""SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS "share_F", round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END), 6) AS "share_O" FROM orders GROUP BY ALL""")
def category_shares(spark, d):
    return LF.category_shares(_t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"])


# Text nodes

_NODES = """n AS (SELECT conv_id AS doc_id, CAST(0 AS INTEGER) AS block, turn AS node, text, length(text) AS size, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM conversations)"""


def _text_nodes(spark, d):
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("block"), F.col("turn").alias("node"), "text")


@_query("WITH " + _NODES + """, o AS (SELECT DISTINCT doc_id, unnest([0, 50, 333, 100000]) AS "offset" FROM n) SELECT o.doc_id, o."offset", n.node, o."offset" - n.first AS place FROM o LEFT JOIN n ON n.doc_id = o.doc_id AND o."offset" >= n.first AND o."offset" < n.first + n.size""")
def node_of_offset(spark, d):
    n = _text_nodes(spark, d)
    o = n.select("doc_id", "block").distinct().withColumn("offset", F.explode(F.array(*[F.lit(v) for v in (0, 50, 333, 100000)])))
    return N.node_at(o, n).select("doc_id", "offset", "node", "place")


@_query("WITH " + _NODES + """, p AS (SELECT doc_id, node, text, first, size, list_sort(list_distinct(list_filter([first, first + size, 10, 31, 60], lambda x: x >= first AND x <= first + size))) AS ps FROM n),
q AS (SELECT *, unnest(CASE WHEN size = 0 THEN [0] ELSE range(0, len(ps) - 1) END) AS piece FROM p)
SELECT doc_id, node, CAST(piece AS INTEGER) AS piece, CASE WHEN size = 0 THEN coalesce(text, '') ELSE substr(text, CAST(ps[piece + 1] - first + 1 AS INTEGER), CAST(ps[piece + 2] - ps[piece + 1] AS INTEGER)) END AS text,
    CASE WHEN size > 0 AND ps[piece + 1] >= 10 AND ps[piece + 2] <= 31 THEN 'a' WHEN size > 0 AND ps[piece + 1] >= 31 AND ps[piece + 2] <= 60 THEN 'b' ELSE '' END AS targets FROM q""")
def nodes_cut_at_links(spark, d):
    """Every conversation's text with two links over it, cut where they begin and end."""
    n = _text_nodes(spark, d)
    doc = n.select("doc_id", "block").distinct()
    links = doc.select("*", F.lit(10).alias("start"), F.lit(30).alias("end"), F.lit("a").alias("target")).unionByName(doc.select("*", F.lit(31).alias("start"), F.lit(59).alias("end"), F.lit("b").alias("target")))
    return N.cut(n, links).select("doc_id", "node", "piece", F.coalesce("text", F.lit("")).alias("text"), F.array_join("targets", ",").alias("targets"))


@_query("""SELECT l_suppkey AS doc_id, l_partkey % 20 AS target, array_to_string(list_sort(list_distinct(list(l_orderkey))), ',') AS sources FROM lineitem WHERE l_orderkey <> l_partkey % 20 GROUP BY ALL""")
def back_references(spark, d):
    x = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 20).alias("target"), F.col("l_orderkey").alias("block"))
    return N.back_references(N.between_blocks(x, "target")).select("doc_id", "target", F.array_join(F.transform("sources", lambda v: v.cast("string")), ",").alias("sources"))


@_query("""WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN '(' || l_linenumber || ')' ELSE 'x' END AS text, l_quantity + CASE WHEN l_linenumber % 2 = 0 THEN 0.3 ELSE 0 END AS r FROM lineitem), m AS (SELECT *, max(r) OVER (PARTITION BY doc_id) AS edge FROM w)
SELECT doc_id, l_linenumber AS number FROM m WHERE text <> 'x' AND abs(r - edge) <= 0.5""")
def equation_labels(spark, d):
    n = F.col("l_linenumber")
    x = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("block"), n.alias("word_no"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("("), n.cast("string"), F.lit(")"))).otherwise("x").alias("text"),
        n.alias("start"), n.alias("end"), (F.col("l_quantity") + F.when(n % 2 == 0, 0.3).otherwise(0.0)).alias("right"),
    )
    return N.equation_labels(x).select("doc_id", "number")


# Whole documents


@_query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'epub' WHEN 3 THEN 'pdf' ELSE 'snapshot' END AS kind, CAST(octet_length(encode(o_orderpriority)) AS BIGINT) AS file_size, md5(o_orderpriority) AS source_hash FROM orders")
def document_routing(spark, d):
    types = F.array(*[F.lit(t) for t in ("application/epub+zip", "application/xhtml+xml", "text/html", "application/pdf", "x-html")])
    x = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.get(types, (F.col("o_orderkey") % 5).cast("int")).alias("content_type"), F.col("o_orderpriority").cast("binary").alias("bytes"))
    return DO.routed(x).select("doc_id", "kind", "file_size", "source_hash")


def _mixed_documents(spark, d):
    """A book of one to three paragraphs and as many notes, or a page of a paragraph, for every supplier; every tenth is
    broken."""
    key = F.col("s_suppkey")
    j = F.sequence(F.lit(1), (key % 3 + 1).cast("int"))
    piece = lambda form: F.array_join(F.transform(j, lambda x: F.format_string(form, x)), "")
    html = F.concat(F.lit("<html><body>"), piece('<p>Text<a href="#n%1$d">%1$d</a></p>'), piece('<aside id="n%1$d" epub:type="footnote">Note</aside>'), F.lit("</body></html>"))
    s = _t(spark, d, "supplier")
    books = E.packed(s.filter(key % 2 == 0).select(key.alias("doc_id"), F.col("s_name").alias("title"), F.col("s_name").alias("label"), html.alias("html")))
    books = books.select("doc_id", F.lit("application/epub+zip").alias("content_type"), F.when(F.col("doc_id") % 10 != 0, F.col("bytes")).alias("bytes"))
    pages = s.filter(key % 2 == 1).select(key.alias("doc_id"), F.lit("text/html").alias("content_type"), F.concat(F.lit("<html><body><article><h1>Head</h1><p>"), F.repeat(F.lit("Some words, and more, of a text. "), 9), F.lit("</p></article></body></html>")).cast("binary").alias("bytes"))
    return books.unionByName(pages)


_MIXED = """s AS (SELECT s_suppkey AS doc_id, s_suppkey % 3 + 1 AS n FROM supplier),
t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN trim(repeat('Some words, and more, of a text. ', 9)) WHEN doc_id % 10 <> 0 THEN array_to_string(list_concat(list_transform(range(1, n + 1), lambda x: 'Text' || x), list_transform(range(1, n + 1), lambda x: 'Note')), chr(10)) END AS text, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 2 * n END AS n FROM s)"""


@_query("WITH " + _MIXED + """ SELECT doc_id, text FROM t WHERE text IS NOT NULL AND doc_id % 2 = 0""")
def document_full_text(spark, d):
    """The full texts of books, from their archives."""
    return DO.full_text(DO.blocks(_mixed_documents(spark, d)).filter("kind = 'epub'")).select("doc_id", "text")


@_query("WITH " + _MIXED + """ SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'snapshot' ELSE 'epub' END AS kind, text IS NULL AS failed, CASE WHEN text IS NULL THEN 'NoBlocks' END AS error FROM t""")
def document_headers(spark, d):
    """Headers of books and pages; broken ones carry an error and fail nothing."""
    docs = _mixed_documents(spark, d)
    x = DO.headers(docs, DO.blocks(docs))
    return x.select("doc_id", "kind", (F.col("n_blocks") == 0).alias("failed"), F.col("error.name").alias("error"))


@_query("""SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'OEBPS/a b.xhtml' WHEN 1 THEN 'OEBPS/a b.xhtml' WHEN 2 THEN 'OEBPS/a b.xhtml' END AS found FROM part""")
def archive_entries(spark, d):
    """Entries found as they are written, percent-decoded and without regard to case."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"))
    paths = F.array(*[F.lit(x) for x in ("OEBPS/a b.xhtml", "OEBPS/a%20b.xhtml", "oebps/A%20B.XHTML", "other")])
    return DO.entry(p.withColumn("name", F.lit("OEBPS/a b.xhtml")), p.withColumn("path", F.get(paths, (F.col("doc_id") % 4).cast("int")))).select("doc_id", "found")


@_query("""SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<h1>')) AS BIGINT) AS headings, 2 AS above FROM pages""")
def page_dom_map(spark, d):
    """Maps of the elements above every page's heading: the heading itself and its article."""
    index = dom.stream_index(dom_nodes(_t(spark, d, "pages")))
    kept = dom.dom_map(index, index.filter("tag = 'h1'"))
    return kept.groupBy("page_id").agg(F.count_if(F.col("tag") == "h1").alias("headings"), F.count(F.lit(1)).cast("int").alias("above"))


# Importing annotations


def _item_marks(spark, d):
    """Raw annotations over the third word of every item, one that exists already, and a note beside it."""
    chars = _item_chars(spark, d)
    w = CH.words(chars).filter("word_no in (1, 2)").select("doc_id", "word_no", "start", "end")
    box = chars.join(w, "doc_id").filter("ord between start and end").groupBy("doc_id", "word_no").agg(F.array(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).alias("rect"))
    none = {"key": "string", "name": "string", "quads": "array<double>", "paths": "array<array<double>>", "border_width": "double", "rotation": "double", "font_size": "double", "text_rect": "array<double>", "modified": "string", "author": "string", "contents": "string", "colour": "array<double>", "alpha": "double", "tags": "string", "parent": "long", "media_box": "array<double>", "crop_box": "array<double>"}
    raw = box.select("doc_id", F.col("word_no").cast("long").alias("ord"), F.lit(0).alias("page_index"), F.explode(F.array(F.lit("Highlight"), F.lit("Text"))).alias("subtype"), "rect", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    raw = raw.withColumn("ord", F.col("ord") * 2 + F.when(F.col("subtype") == "Text", 1).otherwise(0))
    return raw, chars


@_query("WITH " + _ITEM_WORDS + """, m AS (SELECT doc_id, text, upto - length(text) AS start FROM w WHERE word_no = 2)
SELECT doc_id, 'highlight' AS type, text, 'p' || doc_id AS page_label, '00000|' || lpad(CAST(start AS VARCHAR), 6, '0') AS place FROM m""")
def annotations_imported(spark, d):
    """Highlights that don't exist yet, with text, label and place: those of the third word; those of the second exist."""
    raw, chars = _item_marks(spark, d)
    existing = RA.read(raw.filter("ord in (2, 3)"), _PREFIX, F.current_timestamp())
    pages = raw.select("doc_id", "page_index").distinct().select("doc_id", "page_index", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("label"), F.array(*[F.lit(v) for v in RA.LETTER]).alias("view"))
    x = AI.imported(raw, existing, chars, pages, _PREFIX).filter("type <> 'note'")
    return x.select("doc_id", "type", "text", "page_label", F.substring("sort_index", 1, 12).alias("place"))


@_query("SELECT item_id AS doc_id, CAST(2 AS BIGINT) AS gone FROM benchmark WHERE len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) >= 3")
def annotations_gone(spark, d):
    """Existing annotations that are there no more: both of the third word."""
    raw, _ = _item_marks(spark, d)
    read = RA.read(raw, _PREFIX, F.current_timestamp())
    return AI.changes(read.filter("ord < 4"), read)[1].groupBy("doc_id").agg(F.count(F.lit(1)).alias("gone"))


@_query("""SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_partkey % 2 = 0 THEN 'note' ELSE 'highlight' END AS type, l_suppkey % 9 AS page_index, CASE WHEN l_partkey % 2 = 0 THEN l_quantity - 11 ELSE 1.0 END AS x1, CASE WHEN l_partkey % 2 = 0 THEN 39.0 ELSE 7.0 END AS y1, CAST(CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n FROM lineitem WHERE l_partkey % 2 = 1 OR l_suppkey % 4 > 0""")
def third_party_imported(spark, d):
    note = F.col("l_partkey") % 2 == 0
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    x = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.when(note, "note").otherwise("highlight").alias("type"), (F.col("l_suppkey") % 9 + 1).alias("page"),
        F.when(F.col("l_suppkey") % 4 > 0, F.col("l_quantity")).alias("x"), F.lit(50.0).alias("y"), F.when(~note, F.array(array(9, 3, 2, 1), array(5, 9, 1, 7))).alias("rects"),
    )
    y = AI.third_party(x)
    at = lambda i: F.get(F.get("rects", F.lit(0)), F.lit(i))
    return y.select("doc_id", "ord", "type", "page_index", at(0).alias("x1"), at(1).alias("y1"), F.size("rects").alias("n"))
