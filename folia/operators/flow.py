"""Flow of blocks: classes, types, metrics of paragraphs and headings, parts that belong together, rectangles.

Block rows have: doc_id, block (order), type, flow and, where measured, page_index, x1, y1, x2, y2, line_count,
first_indent, first_char, last_rag, last_char.

Edge cases. Null and unknown flow classes are body. Blocks without metrics have no parts. Repeated blocks are blocks of
their own. Empty tables give no rows. Other columns pass through where the docstring doesn't say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .characters import BOX

# Raw block types and the node types that they become.
NODE_TYPES = {
    "title": "heading", "body": "paragraph", "caption": "caption", "image": "image", "table": "table", "footnote": "note", "list_item": "listitem",
    "equation": "math", "preformatted": "preformatted",
}
MOST_RAG, MOST_INDENT, WIDTH_ERROR = 1.0, 1.0, 1.0


def flow_class(flow: Column) -> Column:
    """'auxiliary' or 'excluded', else 'body'."""
    return F.when(flow.isin("auxiliary", "excluded"), flow).otherwise("body")


def normalized(blocks: DataFrame) -> DataFrame:
    """Blocks with flow null for body; excluded blocks are of type body."""
    f = flow_class(F.col("flow"))
    return blocks.withColumn("type", F.when(f == "excluded", "body").otherwise(F.col("type"))).withColumn("flow", F.nullif(f, F.lit("body")))


def top_level(blocks: DataFrame) -> DataFrame:
    """Blocks with depth, flow kept at depth 0 only."""
    return blocks.withColumn("flow", F.when(F.col("depth") == 0, F.nullif(flow_class(F.col("flow")), F.lit("body"))))


def nodes(blocks: DataFrame) -> DataFrame:
    """Blocks with node_type; an unknown type is an error."""
    known = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])[F.col("type")]
    return blocks.withColumn("node_type", F.coalesce(known, F.raise_error(F.concat(F.lit("unknown block type: "), F.coalesce("type", F.lit("null")))).cast("string")))


def page_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, page_index, first, last: the half-open range of a page's blocks."""
    return blocks.groupBy("doc_id", "page_index").agg(F.min("block").alias("first"), (F.max("block") + 1).alias("last"))


def metrics(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, block and a paragraph's metrics from its characters (doc_id, block, ord, c, x1, x2, line_break_after, font,
    size) and its box (doc_id, block, page_index, x1..y2). Blocks without characters have no lines and empty ones."""
    breaks = F.coalesce("line_break_after", F.lit(False))
    item = F.struct("ord", "c", F.col("x1").alias("left"), F.col("x2").alias("right"), breaks.alias("ends"), "font", "size")
    ends = chars.groupBy("doc_id", "block").agg(F.min(item).alias("a"), F.max(item).alias("z"), F.count_if(breaks).alias("n"))
    x = boxes.join(ends, ["doc_id", "block"], "left")
    none = lambda c, other: F.coalesce(c, F.lit(other))
    return x.select(
        "doc_id", "block", "page_index", *BOX, none(F.col("n") + F.when(F.col("z.ends"), 0).otherwise(1), 0).alias("line_count"),
        none(F.col("a.left") - F.col("x1"), 0.0).alias("first_indent"), none(F.col("a.c"), "").alias("first_char"), none(F.col("a.font"), "").alias("first_font"),
        none(F.col("a.size"), 0.0).alias("first_size"), none(F.col("x2") - F.col("z.right"), 0.0).alias("last_rag"), none(F.col("z.c"), "").alias("last_char"),
        none(F.col("z.font"), "").alias("last_font"), none(F.col("z.size"), 0.0).alias("last_size"),
    )


def can_cross(first_page: Column, second_page: Column, first_degraded: Column, second_degraded: Column) -> Column:
    """Whether parts may stand on these pages: the same, or the next one where neither text is degraded."""
    sound = ~F.coalesce(first_degraded, F.lit(False)) & ~F.coalesce(second_degraded, F.lit(False))
    return F.coalesce((first_page == second_page) | ((second_page == first_page + 1) & sound), F.lit(False))


def _begins(c: Column, form: str) -> Column:
    return F.coalesce(F.substring(c, 1, 1).rlike(form), F.lit(False))


def _linked(candidates: DataFrame, extra: Column) -> DataFrame:
    """candidates (doc_id, block, part metrics, degraded, skipped_before) with __next: whether the next one goes on."""
    w = Window.partitionBy("doc_id").orderBy("block")
    after = lambda c: F.lead(c).over(w)
    crossing = can_cross(F.col("page_index"), after("page_index"), F.col("degraded"), after("degraded"))
    return candidates.withColumn("__next", F.coalesce(crossing & extra, F.lit(False)))


def _with_neighbours(linked: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("block")
    back = F.coalesce(F.lag("__next").over(w), F.lit(False))
    return linked.select(
        "doc_id", "block", F.when(back, F.lag("block").over(w)).alias("previous_part"), F.when(F.col("__next"), F.lead("block").over(w)).alias("next_part")
    ).filter("previous_part is not null or next_part is not null")


def paragraph_parts(blocks: DataFrame) -> DataFrame:
    """doc_id, block, previous_part, next_part of body paragraphs that are parts of one: the first ends in a small letter
    or digit (or a hyphen before a small letter) at the right edge, the next begins so at the left edge, their widths
    agree (or the next is one line on the next page), it isn't left of the first on the same page, and only blocks of
    other flow stand between. Needs metrics and degraded (of the page)."""
    w = Window.partitionBy("doc_id").orderBy("block")
    body = (flow_class(F.col("flow")) == "body").cast("int")
    p = blocks.withColumn("__body", F.sum(body).over(w)).filter((F.col("type") == "paragraph") & (flow_class(F.col("flow")) == "body") & F.col("page_index").isNotNull())
    after = lambda c: F.lead(c).over(w)
    goes_on = _begins(F.col("last_char"), "[a-z0-9]") | ((F.col("last_char") == "-") & _begins(after("first_char"), "[a-z]"))
    width, next_width = F.col("x2") - F.col("x1"), after("x2") - after("x1")
    fits = (F.abs(width - next_width) <= WIDTH_ERROR) | ((after("page_index") == F.col("page_index") + 1) & (after("line_count") == 1) & (next_width <= width + WIDTH_ERROR))
    left = F.coalesce((after("page_index") == F.col("page_index")) & (after("x2") <= F.col("x1")), F.lit(False))
    alone = after("__body") == F.col("__body") + 1
    extra = goes_on & (F.col("last_rag") <= MOST_RAG) & (after("first_indent") <= MOST_INDENT) & _begins(after("first_char"), "[a-z0-9]") & fits & ~left & alone
    return _with_neighbours(_linked(p, extra))


def list_item_parts(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, block, previous_part, next_part of list items that go on: a hyphen, then a small letter, in the next item of
    the list or the first of a next list with only blocks of other flow between. items: doc_id, block, list, place (in
    the list), n (items of the list), flow and metrics; blocks: the top-level blocks (doc_id, block = the list's)."""
    w = Window.partitionBy("doc_id").orderBy("block")
    body = (flow_class(F.col("flow")) == "body").cast("int")
    rank = blocks.withColumn("__body", F.sum(body).over(w)).select("doc_id", F.col("block").alias("list"), "__body")
    p = items.filter(flow_class(F.col("flow")) == "body").join(rank, ["doc_id", "list"])
    after = lambda c: F.lead(c).over(w)
    same = (after("list") == F.col("list")) & (after("place") == F.col("place") + 1)
    following = (after("list") > F.col("list")) & (F.col("place") == F.col("n") - 1) & (after("place") == 0) & (after("__body") == F.col("__body") + 1)
    return _with_neighbours(_linked(p, (F.col("last_char") == "-") & _begins(after("first_char"), "[a-z]") & (same | following)))


def with_page_rects(blocks: DataFrame) -> DataFrame:
    """doc_id, block, rects: a block's own rectangles, or those of the blocks below it. blocks: doc_id, block, path (array
    of numbers from the root), rects (may be null)."""
    key = F.array_join("path", ",")
    own = blocks.filter("rects is not null").select("doc_id", "path", "rects")
    # every block with rectangles gives them to those above it, up to the next one that has its own
    up = own.select("doc_id", F.col("path").alias("__from"), "rects", F.explode(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1)))).alias("n")).filter("n < size(__from)")
    up = up.select("doc_id", F.slice("__from", 1, F.col("n")).alias("path"), "__from", "rects")
    hidden = own.select("doc_id", F.col("path").alias("__mid"))
    # blocked where a block between has its own
    between = (up["doc_id"] == hidden["doc_id"]) & (F.size("__mid") > F.size(up["path"])) & (F.size("__mid") < F.size("__from")) & (F.slice("__from", 1, F.size("__mid")) == F.col("__mid"))
    free = up.join(hidden, between, "left_anti")
    below = free.groupBy("doc_id", "path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__from", "rects"))), lambda s: s["rects"])).alias("below"))
    return blocks.join(below, ["doc_id", "path"], "left").select("doc_id", key.alias("block"), F.coalesce("rects", "below").alias("rects"))
