"""Lines, words and pages of documents laid out on a page of 40 lines with cells of 6 by 12 points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES_A_PAGE = 40


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, page_index: one row per line of the text; a null text has one empty line."""
    x = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return x.withColumn("page_index", F.floor(F.col("line_no") / LINES_A_PAGE).cast("int"))


def line_boxes(rows: DataFrame) -> DataFrame:
    """Bounding boxes and inclusive character offsets within the page of non-empty lines."""
    w = Window.partitionBy("doc_id", "page_index").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    n = F.char_length("line")
    x = rows.withColumn("n", n).withColumn("start_offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
    top = F.lit(792.0) - 12 * (F.col("line_no") % LINES_A_PAGE)
    return x.filter("n > 0").select(
        "doc_id", "page_index", "line_no", F.lit(72.0).alias("x1"), (top - 12).alias("y1"), (72.0 + 6 * F.col("n")).alias("x2"), top.alias("y2"),
        "start_offset", (F.col("start_offset") + F.col("n") - 1).alias("end_offset"),
    )


def words(rows: DataFrame) -> DataFrame:
    """doc_id, page_index, line_no, word_no, word: runs of characters other than a space."""
    parts = F.filter(F.split("line", " "), lambda w: w != "")
    return rows.select("doc_id", "page_index", "line_no", F.posexplode(parts).alias("word_no", "word"))


def full_text(rows: DataFrame, pages: Column) -> DataFrame:
    """doc_id, text, extracted_pages, total_pages: lines of the selected pages, form feeds between pages."""
    total = rows.groupBy("doc_id", "page_index").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(pages, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")).alias("t"),
        F.max(pages.cast("int")).alias("taken"),
    )
    return total.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("taken") == 1, F.struct("page_index", "t")))), lambda x: x["t"]), "\f").alias("text"),
        F.sum("taken").alias("extracted_pages"), F.count(F.lit(1)).alias("total_pages"),
    )


def regular_words(all_words: DataFrame) -> DataFrame:
    """Distinct words that are seen wholly in lower case and hold a letter with case."""
    # what is tested depends on a count, so that tests aren't pushed below the grouping: words are stripped once each
    seen = lambda c: F.when(F.col("n") > 0, c)
    once = all_words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    bare = once.select(seen(F.regexp_extract("word", r"(?s)\p{L}(?:.*\p{L})?", 0)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    w = seen(F.col("word"))
    return bare.filter((w == F.lower(w)) & (F.upper(w) != F.lower(w))).select("word")


def modal(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, modal, n: each group's commonest value and how often it occurs; the smallest of equals."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias("modal"), F.max("n").alias("n"))


def gap_features(boxes: DataFrame) -> DataFrame:
    """Gap and shifts to the line before on the page, in shares of the page; 0 for the first."""
    w = Window.partitionBy("doc_id", "page_index").orderBy("line_no")
    gap = F.greatest(F.lag("y1").over(w) - F.col("y2"), F.lit(0.0)) / 792.0
    shift = (F.col("x2") - F.lag("x2").over(w)) / 612.0
    return boxes.select("doc_id", "page_index", "line_no", F.round(F.coalesce(gap, F.lit(0.0)), 6).alias("gap"), F.round(F.coalesce(shift, F.lit(0.0)), 6).alias("shift"))
