"""Reference lists, their inverted index, citations, figures, page labels and link ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.scalars import last_integer, roman


def item_id(text: Column) -> Column:
    """The leading number of a list item, in optional brackets, within its first 24 characters."""
    found = F.regexp_extract(F.substring(text, 1, 24), r"^\s*[\[(]?([0-9]{1,9})[\])]?", 1)
    return F.when(found != "", found.cast("int"))


def has_year(text: Column, now: int) -> Column:
    """Whether a four-digit number from 1800 to the given year stands alone in the text."""
    years = F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(r"(?:[^0-9])([0-9]{4})(?=[^0-9])"), F.lit(1))
    return F.exists(years, lambda y: y.cast("int").between(1800, now))


def valid_lists(items: DataFrame, key: list[str], now: int, share: float = 0.7) -> DataFrame:
    """Lists of which at least `share` of the items hold a year: key, n_items, n_years."""
    x = items.groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(has_year(F.col("text"), now)).alias("n_years"))
    return x.filter(F.col("n_years") >= share * F.col("n_items"))


def name_tokens(items: DataFrame, regular: DataFrame) -> DataFrame:
    """Inverted index rows: capitalized words of two letters or more whose lower form isn't a regular word."""
    x = items.select(*[c for c in items.columns if c != "text"], F.posexplode(F.split("text", r"[^\p{L}]+")).alias("offset", "token"))
    x = x.filter((F.char_length("token") >= 2) & F.col("token").rlike(r"^\p{Lu}"))
    return x.join(regular.select(F.col("word").alias("__w")), F.lower("token") == F.col("__w"), "left_anti")


def numeric_range(text: Column) -> tuple[Column, Column]:
    """First and last number of '[1,3-5]', '(2)' and the like; null for other text."""
    ok = text.rlike(r"^[\[(][0-9, –-]+[\])]$") & text.rlike("[0-9]")
    numbers = F.regexp_extract_all(text, F.lit("([0-9]{1,9})"), F.lit(1))
    return F.when(ok, F.get(numbers, F.lit(0)).cast("int")), F.when(ok, F.element_at(numbers, -1).cast("int"))


def coverage(candidates: DataFrame, references: DataFrame, key: str, group: str, token: str, least: float = 0.3) -> DataFrame:
    """Candidate groups that match more than `least` of their distinct tokens, the best of each key first."""
    x = candidates.select(key, group, token).distinct().join(references.select(key, token).distinct().withColumn("__hit", F.lit(1)), [key, token], "left")
    g = x.groupBy(key, group).agg(F.count(F.lit(1)).alias("n_tokens"), F.coalesce(F.sum("__hit"), F.lit(0)).alias("n_matched"))
    w = Window.partitionBy(key).orderBy(F.desc("n_matched"), group)
    return g.filter(F.col("n_matched") > least * F.col("n_tokens")).withColumn("place", F.row_number().over(w))


def first_captions(captions: DataFrame, key: list[str], order: str) -> DataFrame:
    return captions.groupBy(*key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n"))


def label_candidates(rows: DataFrame, text: str) -> DataFrame:
    """number and kind (arabic or roman) that a line of text offers as a page label."""
    arabic, last_word = last_integer(F.col(text)), F.regexp_extract(text, r"([A-Za-z]+)[^A-Za-z]*$", 1)
    r = roman(last_word)
    return rows.withColumn("number", F.coalesce(arabic, r)).withColumn("kind", F.when(arabic.isNotNull(), "arabic").when(r.isNotNull(), "roman")).filter("number is not null")
