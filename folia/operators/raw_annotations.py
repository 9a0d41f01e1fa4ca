"""Raw annotation dictionaries as rows: reading, validity, colours, dates, deletion, splitting and writing back.

A raw row has: doc_id, page_index, ord, subtype, key and name (the two places of an own id), rect, quads and paths
(arrays of numbers), border_width, rotation, font_size, text_rect, modified, author, contents, colour, alpha, tags
(JSON), parent (ord of the annotation that a popup belongs to), and the page's media_box and crop_box.

Edge cases. Null, short or non-numeric geometry makes a row invalid: it gives no annotation. Null strings are empty.
Repeated rows stay repeated; `operators.annotations` removes duplicates. Empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.scalars import round_half_up
from folia.sources.by_row import by_row

# The subtypes that are read and their names, those that count as markup, sizes.
TYPES = {"Text": "note", "Highlight": "highlight", "Underline": "underline", "Square": "image", "Ink": "ink", "FreeText": "text"}
MARKUP = (
    "Text", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Stamp", "Caret", "Ink",
    "FileAttachment", "Sound", "Redact",
)
NOTE_SIDE = 22.0
LETTER = (0.0, 0.0, 612.0, 792.0)
MOST_POSITION_CHARS = 65000
DATE_FORM = r"([0-9]{4}(?:[0-9]{2}){0,5})"


def own_id(key: Column, name: Column, prefix: str) -> Column:
    """The own key, else what follows the prefix in the name; null for none."""
    named = F.when(F.startswith(name, F.lit(prefix)), F.substring(name, len(prefix) + 1, 1 << 20))
    return F.coalesce(F.nullif(key, F.lit("")), F.nullif(named, F.lit("")))


def transferable(subtype: Column, own: Column) -> Column:
    """Notes, highlights and underlines always, areas, drawings and texts with an own id."""
    always = subtype.isin("Text", "Highlight", "Underline")
    return F.coalesce(always | (subtype.isin("Square", "Ink", "FreeText") & own.isNotNull()), F.lit(False))


def corners(r: Column) -> Column:
    """A rectangle with its smaller coordinates first."""
    x = [F.get(r, F.lit(i)) for i in range(4)]
    return F.array(F.least(x[0], x[2]), F.least(x[1], x[3]), F.greatest(x[0], x[2]), F.greatest(x[1], x[3]))


def page_view(whole: Column, part: Column) -> Column:
    """The part of a media box (whole) that a crop box covers, or all of it where they share no area."""
    low = [F.greatest(F.get(part, F.lit(i)), F.get(whole, F.lit(i))) for i in (0, 1)]
    high = [F.least(F.get(part, F.lit(i)), F.get(whole, F.lit(i))) for i in (2, 3)]
    return F.when((high[0] <= low[0]) | (high[1] <= low[1]), whole).otherwise(F.array(*low, *high))


def numbers(a: Column, multiple: int) -> Column:
    """Whether an array holds numbers alone, a whole multiple of so many and at least so many."""
    sound = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce((F.size(a) > 0) & (F.size(a) % multiple == 0) & sound, F.lit(False))


def quad_rects(quads: Column) -> Column:
    """Rectangles of groups of eight numbers, from the second and third corner of each."""
    at = F.sequence(F.lit(0), (F.size(quads) / 8).cast("int") - 1)
    return F.transform(at, lambda i: corners(F.array(*[F.get(quads, 8 * i + k) for k in (4, 5, 2, 3)])))


def note_square(r: Column, view: Column, side: float = NOTE_SIDE, centre_places: int | None = None) -> Column:
    """A square around the centre, moved into the view; what is left of 0 or beyond the view is set, not shifted. The
    centre is as doubles give it, or rounded to centre_places."""
    c = [(F.get(r, F.lit(i)) + F.get(r, F.lit(i + 2))) / 2 for i in (0, 1)]
    if centre_places is not None:
        k = 10.0**centre_places
        c = [F.rint(x * k) / k for x in c]
    out = {}
    for i in (0, 1):
        low, high = c[i] - side / 2, c[i] + side / 2
        low, high = F.when(low < 0, F.lit(0.0)).otherwise(low), F.when(low < 0, F.lit(side)).otherwise(high)
        end = F.get(view, F.lit(i + 2))
        out[i], out[i + 2] = F.when(high > end, end - side).otherwise(low), F.when(high > end, end).otherwise(high)
    return F.array(*[out[i] for i in range(4)])


def _rounded(rects: Column) -> Column:
    return F.transform(rects, lambda r: F.transform(r, lambda x: round_half_up(x, 3)))


def from_the_top(rects: Column) -> Column:
    """Rectangles from the top of the page down, left to right."""
    order = lambda a, b: F.when(a[1] != b[1], F.when(a[1] > b[1], -1).otherwise(1)).when(a[0] != b[0], F.when(a[0] < b[0], -1).otherwise(1)).otherwise(0)
    return F.array_sort(rects, order)


def _byte(x: Column) -> Column:
    return F.rint(F.greatest(F.lit(0.0), F.least(x, F.lit(255.0))))


def colour_bytes(colour: Column) -> Column:
    """Red, green and blue bytes of none (null), one (grey), three or four (ink) shares. A missing colour and other
    lengths are black."""
    c = [F.get(colour, F.lit(i)) for i in range(4)]
    black = F.array(*[F.lit(0.0)] * 3)
    ink = F.array(*[_byte(255 * (1 - c[i]) * (1 - c[3])) for i in range(3)])
    return (
        F.when(F.size(colour) == 0, F.lit(None)).when(F.size(colour) == 1, F.array(*[_byte(255 * c[0])] * 3))
        .when(F.size(colour) == 3, F.array(*[_byte(255 * x) for x in c[:3]])).when(F.size(colour) == 4, ink).otherwise(black)
    )


def over_white(rgb: Column, alpha: Column) -> Column:
    """Bytes laid over white with an opacity, 0.1 at least; as they are without one."""
    a = F.greatest(alpha, F.lit(0.1))
    return F.when(alpha.isNull(), rgb).otherwise(F.transform(rgb, lambda x: _byte(a * x + (1 - a) * 255)))


def bytes_hex(rgb: Column) -> Column:
    """'#rrggbb', empty without three bytes."""
    two = F.transform(rgb, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0"))
    return F.when(F.size(rgb) == 3, F.concat(F.lit("#"), F.array_join(two, ""))).otherwise("")


def hex_shares(colour: Column) -> Column:
    """Red, green and blue shares of '#rrggbb'; null for other text."""
    parts = [F.regexp_extract(colour, "(?i)^#?([a-f0-9]{2})([a-f0-9]{2})([a-f0-9]{2})$", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.array(*[F.conv(p, 16, 10).cast("double") / 255 for p in parts]))


def date_of(digits: Column, now: Column) -> Column:
    """The UTC time of four to fourteen digits (DATE_FORM finds them); parts that are missing are their first, parts
    beyond their range carry over. now for none."""
    part = lambda at, n, other: F.when(F.length(digits) >= at + n - 1, F.substring(digits, at, n).cast("int")).otherwise(other)
    month = F.greatest(part(5, 2, F.lit(1)), F.lit(1))
    day, hour, minute, second = part(7, 2, F.lit(1)), part(9, 2, F.lit(0)), part(11, 2, F.lit(0)), part(13, 2, F.lit(0))
    first = F.add_months(F.make_date(part(1, 4, F.lit(1970)), F.lit(1), F.lit(1)), month - 1)
    start = F.date_add(first, day - 1).cast("timestamp")
    moved = F.timestamp_seconds(F.unix_timestamp(start) + 3600 * hour + 60 * minute + second)
    return F.when(digits == "", now).otherwise(moved)


def date_text(at: Column) -> Column:
    """A time as the date string of a raw annotation."""
    return F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("Z00'00'"))


def tags_of(text: Column) -> Column:
    """The strings of a JSON array; none where it isn't one or holds anything else."""
    x = F.from_json(text, "array<variant>")
    sound = F.forall(x, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return F.when(F.coalesce(sound, F.lit(False)), F.from_json(text, "array<string>")).otherwise(F.array().cast("array<string>"))


def read(raw: DataFrame, prefix: str, now: Column, centre_places: int | None = None) -> DataFrame:
    """doc_id, ord, page_index, id, type, rects, paths, width, rotation, font_size, date_modified, author, comment,
    colour, tags, transferable: the valid annotations of the six types. centre_places as in `note_square`."""
    own = own_id(F.col("key"), F.col("name"), prefix)
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("subtype")]
    x = raw.withColumn("id", own).withColumn("type", kind).filter("type is not null").filter(~(F.col("type").isin("image", "ink", "text") & F.col("id").isNull()))
    area = F.when(numbers(F.col("quads"), 8), quad_rects(F.col("quads"))).when(numbers(F.col("rect"), 4), F.array(corners(F.col("rect"))))
    # in steps: each uses the columns of the one before more than once
    x = x.withColumns({
        "__area": area, "__whole": F.coalesce("media_box", F.array(*[F.lit(v) for v in LETTER])), "__rgb": colour_bytes(F.col("colour")),
        "__digits": F.regexp_extract(F.coalesce("modified", F.lit("")), DATE_FORM, 1),
    })
    x = x.withColumns({"__first": F.get("__area", F.lit(0)), "__part": corners(F.coalesce("crop_box", "__whole")), "__over_white": over_white(F.col("__rgb"), F.col("alpha"))})
    x = x.withColumn("__view", page_view(F.col("__whole"), F.col("__part")))
    x = x.withColumn("__note", F.when(F.size("__area") == 1, F.array(note_square(F.col("__first"), F.col("__view"), centre_places=centre_places))))
    drawn = F.coalesce(F.forall("paths", lambda p: numbers(p, 2)) & F.col("border_width").isNotNull() & ~F.isnan("border_width"), F.lit(False))
    placed = numbers(F.col("text_rect"), 4) & F.coalesce(~F.isnan("rotation") & ~F.isnan("font_size"), F.lit(False))
    several = F.when(F.col("type") == "note", F.col("__note")).when(F.col("type").isin("highlight", "underline", "image"), F.col("__area"))
    x = x.withColumn("__rects", F.when((F.col("type") == "text") & placed, F.array(corners(F.col("text_rect")))).otherwise(from_the_top(_rounded(several))))
    x = x.withColumn("__paths", F.when((F.col("type") == "ink") & drawn, _rounded(F.col("paths"))))
    # an array of one: a filter on its fields isn't pushed below, where it would repeat all that they come from
    x = x.withColumn("__place", F.explode(F.array(F.struct(F.col("__rects").alias("rects"), F.col("__paths").alias("paths"))))).filter("__place.rects is not null or __place.paths is not null")
    turned = F.when(F.col("type") == "text", round_half_up(F.pmod("rotation", F.lit(360.0))))
    return x.select(
        "doc_id", "ord", "page_index", "id", "type", F.col("__place.rects").alias("rects"), F.col("__place.paths").alias("paths"),
        F.when(F.col("__place.paths").isNotNull(), round_half_up(F.col("border_width"), 3)).alias("width"),
        turned.alias("rotation"), F.when(F.col("type") == "text", round_half_up(F.col("font_size"), 1)).alias("font_size"),
        date_of(F.col("__digits"), now).alias("date_modified"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce("contents", F.lit("")).alias("comment"),
        bytes_hex(F.col("__over_white")).alias("colour"), tags_of(F.col("tags")).alias("tags"), transferable(F.col("subtype"), F.col("id")).alias("transferable"),
    )


def with_markup(raw: DataFrame) -> DataFrame:
    """doc_id, marked: whether a document has any markup annotation."""
    return raw.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("subtype").isin(*MARKUP)), F.lit(False)).alias("marked"))


def without_transferable(raw: DataFrame, prefix: str) -> DataFrame:
    """The raw rows that stay in a document when its transferable annotations leave with their popups."""
    x = raw.withColumn("__goes", transferable(F.col("subtype"), own_id(F.col("key"), F.col("name"), prefix)))
    gone = x.filter("__goes").select(F.col("doc_id").alias("__doc"), F.col("ord").alias("__parent")).distinct()
    left = x.filter("not __goes").drop("__goes")
    popup = (left["subtype"] == "Popup") & (left["doc_id"] == gone["__doc"]) & (left["parent"] == gone["__parent"])
    return left.join(gone, popup, "left_anti")


def number_text(x: Column) -> Column:
    """A number as JSON writes it, whole ones without a point."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def list_text(lists: Column) -> Column:
    """An array of number arrays as JSON."""
    one = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, number_text), ","), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(lists, one), ","), F.lit("]"))


def key_text(type_: Column, page: Column, rects: Column, paths: Column, width: Column, comment: Column) -> Column:
    """What equal annotations have in common: type, page, geometry and comment as one text."""
    place = F.when(type_ == "ink", F.concat(number_text(width), list_text(paths))).otherwise(list_text(rects))
    return F.concat(type_, page.cast("string"), place, F.coalesce(comment, F.lit("")))


def position_text(page: Column, rects: Column, paths: Column, width: Column) -> Column:
    drawn = F.concat(F.lit(',"paths":'), list_text(paths), F.lit(',"width":'), number_text(width))
    return F.concat(F.lit('{"pageIndex":'), page.cast("string"), F.when(paths.isNotNull(), drawn).otherwise(F.concat(F.lit(',"rects":'), list_text(rects))), F.lit("}"))


def _cut(sizes: list[int], base: int, most: int) -> list[int]:
    """The part that each item goes to: a part is full when the next item would pass `most`."""
    out, part, total = [], 0, base
    for n in sizes:
        if total + n > most:
            if total == base:
                raise ValueError("a single rectangle or point doesn't fit")
            part, total = part + 1, base
        total += n
        out.append(part)
    return out


def split_long(annotations: DataFrame, most: int = MOST_POSITION_CHARS) -> DataFrame:
    """Annotations with positions of `most` characters or more in parts: their rectangles or points dealt in order.
    Other columns are repeated; part is a part's number. Needs page_index, rects, paths and width."""
    names = annotations.columns
    sized = annotations.withColumn("__size", F.char_length(position_text(F.col("page_index"), F.col("rects"), F.col("paths"), F.col("width"))))
    short = sized.filter(F.coalesce(F.col("__size") < most, F.lit(True))).drop("__size").withColumn("part", F.lit(0))
    text = lambda x: str(int(x)) if x == int(x) else repr(x)

    def pieces(page_index, rects, paths, width) -> list[tuple]:
        if paths is None:
            base = len(f'{{"pageIndex":{page_index},"rects":[]}}')
            parts: dict[int, list] = {}
            for r, p in zip(rects, _cut([len(",".join(map(text, r))) + 3 for r in rects], base, most), strict=True):
                parts.setdefault(p, []).append(r)
            return [(k, part, None) for k, part in parts.items()]
        base = len(f'{{"pageIndex":{page_index},"paths":[[]],"width":{text(width)}}}')
        points = [(i, float(p[j]), float(p[j + 1])) for i, p in enumerate(paths) for j in range(0, len(p), 2)]
        sizes = [len(f"{text(x)},{text(y)}") + 1 + 3 * (k > 0 and points[k - 1][0] != i) for k, (i, x, y) in enumerate(points)]
        at = _cut(sizes, base, most)
        lines: dict[int, dict[int, list[float]]] = {}
        for (i, x, y), p in zip(points, at, strict=True):
            lines.setdefault(p, {}).setdefault(i, []).extend((x, y))
        return [(k, None, list(part.values())) for k, part in lines.items()]

    def rows(*values):
        row = dict(zip(names, values, strict=True))
        for part, rects, paths in pieces(row["page_index"], row["rects"], row["paths"], row["width"]):
            yield (*(row | {"rects": rects, "paths": paths}).values(), part)

    schema = ", ".join(f"`{c}` {t}" for c, t in annotations.dtypes) + ", part int"
    return short.unionByName(by_row(sized.filter(F.col("__size") >= most).drop("__size"), rows, schema))


def quads_of(rects: Column) -> Column:
    """Eight numbers per rectangle: upper left, upper right, lower left and lower right corner."""
    return F.flatten(F.transform(rects, lambda r: F.array(*[F.get(r, F.lit(i)) for i in (0, 3, 2, 3, 0, 1, 2, 1)])))


def bounding_rect(rects: Column, paths: Column) -> Column:
    """The smallest rectangle around rectangles or, where there are none, paths."""
    side = lambda i, pick: pick(F.transform(rects, lambda r: F.get(r, F.lit(i))))
    flat = F.flatten(paths)
    even, odd = F.filter(flat, lambda _, i: i % 2 == 0), F.filter(flat, lambda _, i: i % 2 == 1)
    around = F.array(F.array_min(even), F.array_min(odd), F.array_max(even), F.array_max(odd))
    return F.when(rects.isNotNull(), F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))).when(paths.isNotNull(), around)


def fitted(r: Column, within: Column) -> Column:
    """A rectangle cut to another one."""
    return F.array(*[(F.greatest if i < 2 else F.least)(F.get(r, F.lit(i)), F.get(within, F.lit(i))) for i in range(4)])


def drawn_box(r: Column, view: Column, padding: float = 10.0, least: float = 30.0) -> Column:
    """The box of a drawing: padded, sides under `least` widened to twice that around their middle, cut to the view."""
    out = {}
    for i in (0, 1):
        low, high = F.get(r, F.lit(i)) - padding, F.get(r, F.lit(i + 2)) + padding
        mid, small = (low + high) / 2, high - low < least
        out[i], out[i + 2] = F.when(small, mid - least).otherwise(low), F.when(small, mid + least).otherwise(high)
    return fitted(F.array(*[out[i] for i in range(4)]), view)


def raster_scale(r: Column, scale: float = 4.0, most_pixels: int = 16777216) -> Column:
    """The scale at which a box is drawn: lower where its raster would have too many points."""
    area = (F.get(r, F.lit(2)) - F.get(r, F.lit(0))) * (F.get(r, F.lit(3)) - F.get(r, F.lit(1)))
    return F.least(F.lit(scale), F.sqrt(most_pixels / area))


def on_screen(r: Column, view: Column, scale: Column) -> Column:
    """A page rectangle in the coordinates of an unrotated screen whose origin is the view's upper left corner."""
    x = [(F.get(r, F.lit(i)) - F.get(view, F.lit(0))) * scale for i in (0, 2)]
    y = [(F.get(view, F.lit(3)) - F.get(r, F.lit(i))) * scale for i in (1, 3)]
    return corners(F.array(x[0], y[0], x[1], y[1]))


def written(annotations: DataFrame) -> DataFrame:
    """doc_id, page_index, ord, subtype, rect, quads, paths, colour, modified, contents, parent: raw rows of
    annotations (columns of `read`), with a popup behind every highlight or underline that has a comment."""
    back = F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (v, k)])
    box = bounding_rect(F.col("rects"), F.col("paths"))
    raw = annotations.select(
        "doc_id", "page_index", "ord", back[F.col("type")].alias("subtype"), box.alias("rect"),
        F.when(F.col("type").isin("highlight", "underline"), quads_of(F.col("rects"))).alias("quads"), F.when(F.col("type") == "ink", F.col("paths")).alias("paths"),
        hex_shares(F.col("colour")).alias("colour"), date_text(F.col("date_modified")).alias("modified"), F.col("comment").alias("contents"), F.lit(None).cast("long").alias("parent"),
    )
    nothing = {"quads": "array<double>", "paths": "array<array<double>>", "colour": "array<double>", "modified": "string", "contents": "string"}
    popups = raw.filter(F.col("subtype").isin("Highlight", "Underline") & (F.coalesce("contents", F.lit("")) != "")).select(
        "doc_id", "page_index", "ord", F.lit("Popup").alias("subtype"), "rect", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.col("ord").cast("long").alias("parent")
    )
    return raw.unionByName(popups)


def regenerated_labels(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, page_index, style, prefix, start: the label entries of documents after pages were removed. pages:
    doc_id, page_index, style, prefix, start (of the entry at a page; has_entry tells pages that have one)."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("page_index")
    run = F.sum(F.col("has_entry").cast("int")).over(w)
    in_run = Window.partitionBy("doc_id", "run").orderBy("page_index")
    x = pages.withColumn("run", run)
    number = F.coalesce(F.first("start").over(in_run), F.lit(1)) + F.row_number().over(in_run) - 1
    x = x.select("doc_id", "page_index", F.first("style").over(in_run).alias("style"), F.first("prefix").over(in_run).alias("prefix"), number.alias("start"))
    left = x.join(removed.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti")
    left = left.withColumn("new_index", F.row_number().over(w) - 1)
    # an entry stays where style or prefix change or the number doesn't follow on the entry before: entries, not pages, are compared
    item = F.struct("new_index", "style", "prefix", "start")
    rows = left.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    last = lambda kept: F.element_at(kept, -1)
    follows = lambda kept, x: (F.size(kept) > 0) & last(kept)["style"].eqNullSafe(x["style"]) & last(kept)["prefix"].eqNullSafe(x["prefix"]) & (last(kept)["start"] + 1 == x["start"])
    start = F.slice("rows", 1, 0)
    kept = F.aggregate("rows", start, lambda kept, x: F.when(F.coalesce(follows(kept, x), F.lit(False)), kept).otherwise(F.concat(kept, F.array(x))))
    return rows.select("doc_id", F.explode(kept).alias("x")).select("doc_id", F.col("x.new_index").alias("page_index"), "x.style", "x.prefix", "x.start")


def repointed(refs: DataFrame, removed: DataFrame, other: DataFrame) -> DataFrame:
    """refs (doc_id, ord, target) whose removed targets are replaced by the document's other one. removed: doc_id,
    target; other: doc_id, other."""
    gone = removed.select("doc_id", "target", F.lit(True).alias("__gone")).distinct()
    x = refs.join(gone, ["doc_id", "target"], "left").join(other, "doc_id", "left")
    return x.select("doc_id", "ord", F.when(F.col("__gone"), F.col("other")).otherwise(F.col("target")).alias("target"))


def wrapped(glyphs: DataFrame, key: list[str], order: str, width: Column, font_size: Column) -> DataFrame:
    """key, line, text: text wrapped at blanks into lines no wider than `width`, greedily by word. glyphs: a row per
    character c with its advance (thousandths of the font size)."""
    rows = glyphs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, "c", "advance"))).alias("g"), F.max(width).alias("most"), F.max(font_size).alias("size"))

    def run(frames):
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                lines, line, used = [], "", 0.0
                g = list(row.g)
                word = 0.0  # width of the word that follows, from behind
                ahead = []
                for x in reversed(g):
                    ahead.append(word)
                    word = 0.0 if x["c"] == " " else word + x["advance"] / 1000 * row.size
                for x, following in zip(g, reversed(ahead), strict=True):
                    if x["c"] == " " and used + following > row.most and line:
                        lines, line, used = [*lines, line], "", 0.0
                        continue
                    line, used = line + x["c"], used + x["advance"] / 1000 * row.size
                lines += [line] if line else []
                out += [(*[getattr(row, c) for c in key], k, t) for k, t in enumerate(lines)]
            yield pd.DataFrame(out, columns=[*key, "line", "text"])

    types = dict(glyphs.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in key) + ", line int, text string")
