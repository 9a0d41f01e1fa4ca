"""Importing annotations: those that are new, cut to size, with their page's label, text and place in reading order.

Annotations have the columns of `raw_annotations.read`; chars those of `characters`; pages: doc_id, page_index, label,
view (rectangle).

Edge cases. Annotations on pages without characters have offset 0 and no text; on unknown pages no label and height
792. Null comments are empty in keys. Equal annotations count once, the last of them at the place of the first. Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.scalars import rect_gap, sort_index

from . import characters as CH
from . import raw_annotations as RA

# Fixed value: a highlight without text that is wider than this is an area.
LEAST_AREA_WIDTH = 20.0


def keyed(annotations: DataFrame) -> DataFrame:
    """annotations with key: type, page, geometry and comment as one text."""
    c = F.col
    return annotations.withColumn("key", RA.key_text(c("type"), c("page_index"), c("rects"), c("paths"), c("width"), c("comment")))


def changes(current: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The current annotations that don't exist yet, each once, and the ids of existing ones that are gone."""
    w = Window.partitionBy("doc_id", "key")
    now = keyed(current).withColumn("__first", F.min("ord").over(w)).withColumn("__last", F.max("ord").over(w)).filter(F.col("ord") == F.col("__last"))
    now = now.withColumn("ord", F.col("__first")).drop("__first", "__last").dropDuplicates(["doc_id", "key"])
    old = keyed(existing)
    new = now.join(old.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    gone = old.join(now.select("doc_id", "key"), ["doc_id", "key"], "left_anti").select("doc_id", "id")
    return new.select(*current.columns), gone


def enriched(annotations: DataFrame, chars: DataFrame, pages: DataFrame, keep_text: bool = False, areas: bool = True) -> DataFrame:
    """annotations with page_label, text (of highlights), sort_index; wide highlights without text become areas. With
    keep_text a highlight's own text stays. Needs ord, part."""
    a = annotations.withColumn("__id", F.concat_ws("|", "doc_id", "ord", "part"))
    if "text" not in a.columns:
        a = a.withColumn("text", F.lit(None).cast("string"))
    box = RA.bounding_rect(F.when(F.size("rects") > 0, F.slice("rects", 1, 1)), F.col("paths"))
    a = a.withColumn("__box", box)
    marks = a.filter("type = 'highlight'").select(F.col("__id").alias("id"), "doc_id", "page_index", "rects")
    found = CH.highlighted(marks, chars).filter("anchor is not null").join(marks.select("id", "doc_id", "page_index"), "id")
    texts = CH.ranges(found, chars).select("id", F.col("text").alias("__text")).join(found.select("id", F.col("anchor").alias("__anchor")), "id")
    rest = a.filter("type <> 'highlight'").select("__id", F.col("doc_id").alias("__doc"), F.col("page_index").alias("__page"), "__box")
    gap = rect_gap([F.get("__box", F.lit(i)) for i in range(4)], [F.col(c) for c in CH.BOX])
    near = rest.join(chars, (chars["doc_id"] == rest["__doc"]) & (chars["page_index"] == rest["__page"])).groupBy("__id").agg(F.min(F.struct(gap.alias("gap"), "ord"))["ord"].alias("__near"))
    p = pages.select("doc_id", "page_index", F.col("label").alias("page_label"), F.get("view", F.lit(3)).alias("__height"))
    x = a.join(texts.withColumnRenamed("id", "__id"), "__id", "left").join(near, "__id", "left").join(p, ["doc_id", "page_index"], "left")
    own = F.col("text").isNotNull() & (F.col("text") != "") if keep_text else F.lit(False)
    x = x.withColumn("text", F.when(own, F.col("text")).otherwise(F.col("__text")))
    top = F.coalesce("__height", F.lit(792.0)) - F.get("__box", F.lit(3))
    x = x.withColumn("sort_index", sort_index(F.col("page_index"), F.coalesce("__anchor", "__near", F.lit(0)), top))
    wide = (F.size("rects") == 1) & (F.get("__box", F.lit(2)) - F.get("__box", F.lit(0)) > LEAST_AREA_WIDTH)
    area = F.coalesce((F.col("type") == "highlight") & wide & (F.coalesce("text", F.lit("")) == ""), F.lit(False)) if areas else F.lit(False)
    x = x.withColumn("__area", area)
    return x.withColumn("type", F.when(F.col("__area"), "image").otherwise(F.col("type"))).withColumn("text", F.when(~F.col("__area"), F.col("text"))).select(
        *annotations.columns, *([] if "text" in annotations.columns else ["text"]), "page_label", "sort_index"
    )


def imported(raw: DataFrame, existing: DataFrame, chars: DataFrame, pages: DataFrame, prefix: str, now=None) -> DataFrame:
    """The new annotations of raw rows, cut to size and enriched; existing ones have the columns of `raw_annotations.read`."""
    new, _ = changes(RA.read(raw, prefix, F.current_timestamp() if now is None else now), existing)
    return enriched(RA.split_long(new), chars, pages)


def third_party(notes: DataFrame) -> DataFrame:
    """Annotations of another program: notes (page from 1, x, y) as squares around their point, highlights (rects of any
    corners) sorted from the top; one single rectangle that is large and nearly square is an area. Rows without a page or
    place are left out. notes: doc_id, ord, type, page, x, y, rects."""
    square = F.array(F.col("x") - RA.NOTE_SIDE / 2, F.col("y") - RA.NOTE_SIDE / 2, F.col("x") + RA.NOTE_SIDE / 2, F.col("y") + RA.NOTE_SIDE / 2)
    placed = F.when(F.col("type") == "note", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.array(square))).otherwise(F.transform("rects", RA.corners))
    x = notes.filter("page is not null").withColumn("rects", RA.from_the_top(F.transform(placed, lambda r: F.transform(r, lambda v: F.floor(v * 1000 + 0.5) / 1000))))
    return x.filter("rects is not null and size(rects) > 0").select("doc_id", "ord", "type", (F.col("page") - 1).alias("page_index"), "rects")
