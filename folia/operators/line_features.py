"""What a line's text and a page's objects look like: classes of starts and ends, shares, hashes, scores.

Edge cases. Null and empty texts have class OTHER, share 0, hashes 0 and are no captions. Objects without a rectangle
score 0. Repeated rows are objects of their own. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.scalars import normalized

# The class codes, the signs of bullets, dashes and quotes, the hash and its number of buckets.
UPPER, LOWER, DIGIT, PUNCTUATION, OTHER = 0, 1, 2, 3, 4
BULLET, NUMBERED, ROMAN, LETTERED, DASH, OPENING = 5, 6, 7, 8, 10, 11
SENTENCE_END, HYPHEN, CLOSING = 5, 6, 7
BULLETS = "•·‣◦●○▪▫■□◆◇▶►❖*+"
DASHES = r"\p{Pd}⁓⁻₋−"
QUOTES = r"\x22'«»‘-‟‹›⹂「-』〝-〟﹁-﹄＂＇｢｣"
HASH_START, HASH_FACTOR, HASH_BUCKETS = 0x811C9DC5, 16777619, 32768
MOST_OBJECTS = 256


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over a text's UTF-16 units."""
    step = lambda h, unit: F.pmod(h.bitwiseXOR(unit) * HASH_FACTOR, F.lit(1 << 32))

    def char(h, c):
        code = F.ascii(c).cast("long")
        high, low = 0xD800 + F.shiftright(code - 0x10000, 10), 0xDC00 + F.pmod(code - 0x10000, F.lit(1024))
        return F.when(code > 0xFFFF, step(step(h, high), low)).otherwise(step(h, code))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(HASH_START).cast("long"), char)


def first_hashes(text: Column, n: int = 3) -> Column:
    """Buckets of the first n words, numbers (all alike), full stops or colons; 0 for those that are missing."""
    found = F.slice(F.regexp_extract_all(normalized(text, "NFKC"), F.lit(r"(\p{L}+|[0-9]+|[.:])"), F.lit(1)), 1, n)
    token = lambda x: F.when(x.rlike("^[0-9]+$"), "<NUM>").otherwise(F.lower(x))
    hashed = F.transform(found, lambda x: F.pmod(fnv1a(token(x)), F.lit(HASH_BUCKETS)).cast("int"))
    return F.slice(F.concat(F.coalesce(hashed, F.array().cast("array<int>")), F.array(*[F.lit(0)] * n)), 1, n)


def char_class(c: Column) -> Column:
    """Capital, other letter, digit, punctuation or other."""
    known = F.when(c.rlike(r"^\p{IsAlphabetic}"), F.when(c.rlike(r"^\p{IsUppercase}"), UPPER).otherwise(LOWER)).when(c.rlike(r"^\p{Nd}"), DIGIT).when(c.rlike(r"^\p{IsPunctuation}"), PUNCTUATION)
    return F.coalesce(known, F.lit(OTHER))


def start_class(text: Column) -> Column:
    """The class of a line's start; the first that fits of bullet, number, roman number, letter, dash, quote or opening
    sign, else of its first character. Captions are a flag of their own."""
    sign = rf"[.):{DASHES}]"
    known = (
        F.when(text.rlike(f"^[{BULLETS}]"), BULLET).when(text.rlike(rf"^\(?\p{{Nd}}+(?:[.․]\p{{Nd}}+)*\)?{sign}"), NUMBERED)
        .when(text.rlike(rf"(?i)^\(?[ivxlcdm]+\)?{sign}"), ROMAN).when(text.rlike(rf"^\(?\p{{L}}\)?{sign}"), LETTERED)
        .when(text.rlike(f"^[{DASHES}]"), DASH).when(text.rlike(rf"^(?:[{QUOTES}]|\p{{Ps}})"), OPENING)
    )
    return F.coalesce(known, char_class(F.substring(text, 1, 1)))


def end_class(text: Column) -> Column:
    """The class of a line's end. The hyphen's form is read literally, as its rule is written: it never fits a dash."""
    known = (
        F.when(text.rlike(r"(?:[…‥]|\.{3,}|[.!?;:])\z"), SENTENCE_END).when(F.endswith(text, F.lit("p{Dash}")), HYPHEN)
        .when(text.rlike(rf"[\p{{Pe}}{QUOTES}]\z"), CLOSING)
    )
    return F.coalesce(known, char_class(F.substring(text, -1, 1)))


def is_caption(text: Column) -> Column:
    """Whether a line begins with a word of three letters or more that isn't written small, and a number."""
    parts = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""), " ")
    first = F.substring(text, 1, 1)
    numbered = F.get(parts, F.lit(1)).rlike(r"^\p{N}+$") | F.get(parts, F.lit(1)).rlike("^[ivxlcdm]+$")
    return F.coalesce((text != "") & (F.upper(first) == first) & (F.char_length(F.get(parts, F.lit(0))) >= 3) & numbered, F.lit(False))


def upper_share(text: Column) -> Column:
    """The share of characters that are their own capitals, to two places."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.coalesce(F.round(F.size(F.filter(chars, lambda c: c == F.upper(c))) / F.nullif(F.size(chars), F.lit(0)), 2), F.lit(0.0))


def object_scores(objects: DataFrame) -> DataFrame:
    """objects (page keys, ord, x1..y2, width and height of the page) with perimeter and area in shares of the page."""
    w, h = (F.greatest(F.abs(F.coalesce(c, F.lit(1.0))), F.lit(1.0)) for c in ("width", "height"))
    across, down = F.abs(F.col("x2") - F.col("x1")) / w, F.abs(F.col("y2") - F.col("y1")) / h
    return objects.withColumn("perimeter", F.coalesce(across + down, F.lit(0.0))).withColumn("area", F.coalesce(across * down, F.lit(0.0)))


def largest_objects(objects: DataFrame, keys: list[str], most: int = MOST_OBJECTS) -> DataFrame:
    """The objects of each page that have the largest perimeter, then area, then come first: at most so many."""
    order = Window.partitionBy(*keys).orderBy(F.desc("perimeter"), F.desc("area"), "ord")
    return object_scores(objects).withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= most).drop("__place")


def line_ratios(text: Column) -> dict[str, Column]:
    """Shares of a line's characters by kind, and its numbers of characters and words."""
    n = F.nullif(F.char_length(text), F.lit(0))
    share = lambda form: F.coalesce(F.round(F.regexp_count(text, F.lit(form)) / n, 6), F.lit(0.0))
    return {
        "letters": share(r"\p{L}"), "digits": share(r"\p{Nd}"), "punctuation": share(r"\p{IsPunctuation}"), "blanks": share(r"\s"), "capitals": share(r"\p{Lu}"),
        "n_chars": F.coalesce(F.char_length(text), F.lit(0)), "n_words": F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)),
    }


def category_shares(rows: DataFrame, keys: list[str], category: str, values: list) -> DataFrame:
    """keys and, for each value, the share of rows that have it."""
    return rows.groupBy(*keys).agg(*[F.round(F.count_if(F.col(category) == v) / F.count(F.lit(1)), 6).alias(f"share_{v}") for v in values])


def page_ranks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys of the page, ord, y1, y2, size) with their place on the page from 0 to 1 by order, height and size."""
    def place(order):
        w = Window.partitionBy(*keys)
        n = F.count(F.lit(1)).over(w) - 1
        return F.coalesce(F.round((F.rank().over(w.orderBy(order)) - 1) / F.nullif(n, F.lit(0)), 6), F.lit(0.0))

    return blocks.withColumn("place", place("ord")).withColumn("height_place", place(F.col("y2") - F.col("y1"))).withColumn("size_place", place("size"))


def neighbour_gaps(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with the differences to the block before and the one after: gap, left and right edge, size; 0 at the ends."""
    w = Window.partitionBy(*keys).orderBy("ord")
    out = blocks
    for name, f in (("before", F.lag), ("after", F.lead)):
        other = lambda c, f=f: f(c).over(w)
        gap = other("y1") - F.col("y2") if name == "before" else F.col("y1") - other("y2")
        pairs = {"gap": gap, "left": F.col("x1") - other("x1"), "right": F.col("x2") - other("x2"), "size": F.col("size") - other("size")}
        for k, c in pairs.items():
            out = out.withColumn(f"{k}_{name}", F.coalesce(c, F.lit(0.0)))
    return out


def classified(blocks: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with type and flow of a classifier: its paragraphs are of type body, missing flow is body."""
    p = predictions.select(*keys, F.col("type").alias("__type"), F.col("flow").alias("__flow"))
    kind = F.when(F.col("__type") == "paragraph", "body").otherwise(F.coalesce("__type", "type"))
    return blocks.join(p, keys, "left").withColumn("type", kind).withColumn("flow", F.coalesce("__flow", F.lit("body"))).drop("__type", "__flow")
