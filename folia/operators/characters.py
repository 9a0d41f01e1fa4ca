"""The character layer: words, lines, ranges and rectangles of characters placed on pages.

chars: doc_id, page_index, ord (gapless from 0 on a page), c, x1, y1, x2, y2, and the flags space_after,
line_break_after, paragraph_break_after, ignorable.

Edge cases. Null flags are false. Null coordinates take no part in boxes. Documents without characters have no words,
lines or ranges. Repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.scalars import round_half_up

BOX = ("x1", "y1", "x2", "y2")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def placed(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Characters of laid-out lines (key, page_index, line_no, line): cells of 6 by 12 points, blanks as flags. An empty
    line behind a line is the end of its paragraph."""
    n = F.col("line_no")
    after = F.lead("line").over(Window.partitionBy(key).orderBy("line_no"))
    x = rows.withColumn("__after", after).select(key, "page_index", "line_no", "line", "__after", F.posexplode(F.split("line", "")).alias("pos", "c"))
    rest = F.substring("line", F.col("pos") + 2, F.char_length("line"))
    x = x.filter(~F.col("c").isin(" ", "")).select(
        key, "page_index", "line_no", "pos", "c", F.startswith(rest, F.lit(" ")).alias("space_after"), (F.trim(rest) == "").alias("line_break_after"),
        ((F.trim(rest) == "") & (F.trim(F.coalesce("__after", F.lit(""))) == "")).alias("paragraph_break_after"), F.lit(False).alias("ignorable"),
        (72.0 + 6 * F.col("pos")).alias("x1"), (780.0 - 12 * (n % 40)).alias("y1"), (78.0 + 6 * F.col("pos")).alias("x2"), (792.0 - 12 * (n % 40)).alias("y2"),
    )
    w = Window.partitionBy(key, "page_index").orderBy("line_no", "pos")
    return x.withColumn("ord", (F.row_number().over(w) - 1).cast("int"))


def _islands(chars: DataFrame, key: str, breaks: Column, name: str) -> DataFrame:
    """chars with a number that rises behind every break, within a page."""
    w = Window.partitionBy(key, "page_index").orderBy("ord")
    begins = F.coalesce(F.lag(breaks.cast("int")).over(w), F.lit(0))
    return chars.withColumn("__begins", begins).withColumn(name, F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__begins")


def words(chars: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page_index, word_no, text, start, end, right: runs up to a blank, a line's or a page's end."""
    x = _islands(chars, key, _flag("space_after") | _flag("line_break_after"), "word_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "c"))), lambda s: s["c"]), "")
    return x.groupBy(key, "page_index", "word_no").agg(text.alias("text"), F.min("ord").alias("start"), F.max("ord").alias("end"), F.max("x2").alias("right"))


def lines(chars: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page_index, line_no, text, start, end and the box, rounded to two places."""
    x = _islands(chars, key, _flag("line_break_after"), "line")
    box = [round_half_up(f(c), 2).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX, strict=True)]
    return x.groupBy(key, "page_index", F.col("line").alias("line_no")).agg(joined_text().alias("text"), F.min("ord").alias("start"), F.max("ord").alias("end"), *box)


def joined_text() -> Column:
    """An aggregate: the characters that aren't ignorable, blanks behind words, lines and paragraphs, trimmed."""
    blank = F.concat(F.when(_flag("space_after") | _flag("line_break_after"), " ").otherwise(""), F.when(_flag("paragraph_break_after"), " ").otherwise(""))
    one = F.when(~_flag("ignorable"), F.struct("ord", F.concat("c", blank).alias("t")))
    return F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]), ""))


def ranges(asked: DataFrame, chars: DataFrame, key: str = "doc_id") -> DataFrame:
    """id, text, rects: of the characters from anchor to before head, either way round; a rectangle for each line,
    rounded to three places. Equal ends give empty text and no rectangle. asked: id, key, page_index, anchor, head."""
    a = asked.select("id", F.col(key).alias("__key"), F.col("page_index").alias("__page"), F.least("anchor", "head").alias("__from"), (F.greatest("anchor", "head") - 1).alias("__to"))
    on = (chars[key] == a["__key"]) & (chars["page_index"] == a["__page"]) & (chars["ord"] >= a["__from"]) & (chars["ord"] <= a["__to"])
    inside = _islands(chars, key, _flag("line_break_after"), "line").join(a, on)
    by_line = inside.groupBy("id", "line").agg(joined_text_parts().alias("parts"), *[round_half_up(f(c), 3).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX, strict=True)])
    whole = by_line.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "parts", F.array(*BOX).alias("rect")))).alias("x"))
    got = whole.select("id", F.trim(F.array_join(F.transform("x", lambda s: s["parts"]), "")).alias("text"), F.transform("x", lambda s: s["rect"]).alias("rects"))
    return asked.select("id").join(got, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("rects", F.array().cast("array<array<double>>")).alias("rects"))


def joined_text_parts() -> Column:
    """joined_text without the final trim: for texts put together from parts."""
    blank = F.concat(F.when(_flag("space_after") | _flag("line_break_after"), " ").otherwise(""), F.when(_flag("paragraph_break_after"), " ").otherwise(""))
    one = F.when(~_flag("ignorable"), F.struct("ord", F.concat("c", blank).alias("t")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]), "")


def highlighted(highlights: DataFrame, chars: DataFrame, key: str = "doc_id") -> DataFrame:
    """id, anchor, head: from the first to behind the last character whose centre lies in one of a highlight's
    rectangles; null for highlights that hold none. highlights: id, key, page_index, rects."""
    h = highlights.select("id", F.col(key).alias("__key"), F.col("page_index").alias("__page"), F.explode("rects").alias("r"))
    r = [F.get("r", F.lit(i)) for i in range(4)]
    cx, cy = F.col("x1") + (F.col("x2") - F.col("x1")) / 2, F.col("y1") + (F.col("y2") - F.col("y1")) / 2
    on = (chars[key] == h["__key"]) & (chars["page_index"] == h["__page"]) & (cx >= r[0]) & (cx <= r[2]) & (cy >= r[1]) & (cy <= r[3])
    hit = h.join(chars, on).groupBy("id").agg(F.min("ord").alias("anchor"), (F.max("ord") + 1).alias("head"))
    return highlights.select("id").join(hit, "id", "left")


def rects_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two rectangles have a point in common, edges included."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def block_rects(chars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page_index and the rectangle around a block's characters on each page."""
    return chars.groupBy(*keys, "page_index").agg(*[f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX, strict=True)])


def recognizer_words(chars: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page_index, word_no, text, the box rounded to four places and the commonest font size of every word."""
    x = _islands(chars, key, _flag("space_after") | _flag("line_break_after"), "word_no")
    box = [round_half_up(f(c), 4).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX, strict=True)]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "c"))), lambda s: s["c"]), "")
    return x.groupBy(key, "page_index", "word_no").agg(text.alias("text"), *box, F.min("y1").alias("baseline"))
