"""Text nodes of blocks: which node an offset is in, nodes cut at references, references back.

nodes: doc_id, block, node (order), text. Links: doc_id, block, start, end (inclusive), target. Offsets count over a
block's whole text from 0.

Edge cases. Nodes without text hold no offset and stay whole. Offsets beyond the text have no node. Equal links count
once. Blocks without links stay as they are; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed(nodes: DataFrame) -> DataFrame:
    """nodes with first, the offset of their first character, and size."""
    w = Window.partitionBy("doc_id", "block").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.char_length("text"), F.lit(0))
    return nodes.withColumn("size", size).withColumn("first", F.coalesce(F.sum("size").over(w), F.lit(0)))


def node_at(offsets: DataFrame, nodes: DataFrame) -> DataFrame:
    """offsets (doc_id, block, offset) with node and the place in it."""
    n = placed(nodes).select(F.col("doc_id").alias("__doc"), F.col("block").alias("__block"), "node", "first", "size")
    on = (offsets["doc_id"] == n["__doc"]) & (offsets["block"] == n["__block"]) & (offsets["offset"] >= n["first"]) & (offsets["offset"] < n["first"] + n["size"])
    return offsets.join(n, on, "left").withColumn("place", F.col("offset") - F.col("first")).drop("__doc", "__block", "first", "size")


def cut(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, block, node, piece, text, targets: nodes cut where a link begins or ends; targets are those of the links
    over a piece, in order."""
    n = placed(nodes)
    spans = links.groupBy("doc_id", "block").agg(F.collect_set(F.struct("start", "end", "target")).alias("links"))
    x = n.join(spans, ["doc_id", "block"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<start:int,end:int,target:string>>")))
    last = F.col("first") + F.col("size")
    inside = lambda p: (p > F.col("first")) & (p < last)
    points = F.concat(F.transform("links", lambda s: s["start"].cast("long")), F.transform("links", lambda s: s["end"].cast("long") + 1))
    ends = F.array_sort(F.array_distinct(F.concat(F.array(F.col("first").cast("long"), last.cast("long")), F.filter(points, inside))))
    pieces = F.transform(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(1))), lambda p, i: F.struct(p.alias("a"), F.coalesce(F.get(ends, i + 1), p).alias("b")))
    y = x.select("doc_id", "block", "node", "text", "first", "links", F.posexplode(pieces).alias("piece", "p"))
    over = F.filter("links", lambda s: (s["start"] < F.col("p.b")) & (s["end"] >= F.col("p.a")))
    return y.select(
        "doc_id", "block", "node", "piece", F.substring("text", (F.col("p.a") - F.col("first") + 1).cast("int"), (F.col("p.b") - F.col("p.a")).cast("int")).alias("text"),
        F.array_distinct(F.transform(F.array_sort(over), lambda s: s["target"])).alias("targets"),
    )


def back_references(links: DataFrame) -> DataFrame:
    """doc_id, target, sources: the blocks that refer to a target, each once, in order."""
    return links.groupBy("doc_id", "target").agg(F.array_sort(F.collect_set("block")).alias("sources"))


def between_blocks(links: DataFrame, target_block: str = "target_block") -> DataFrame:
    """Links that lead to another block than their own."""
    return links.filter(~F.col("block").eqNullSafe(F.col(target_block)))


def equation_labels(words: DataFrame, error: float = 0.5) -> DataFrame:
    """doc_id, block, number, start, end: the words '(n)' of a block whose right edge is the block's own, up to an error.
    words: doc_id, block, word_no, text, start, end, right."""
    w = Window.partitionBy("doc_id", "block")
    number = F.regexp_extract("text", r"^\(([0-9]+)\)$", 1)
    x = words.withColumn("edge", F.max("right").over(w)).withColumn("number", number)
    return x.filter((F.col("number") != "") & (F.abs(F.col("right") - F.col("edge")) <= error)).select("doc_id", "block", F.col("number").cast("int").alias("number"), "start", "end")
