"""Column functions shared by the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves towards plus infinity, also below zero."""
    k = 10**places
    return F.floor(x * k + 0.5) / k


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points beyond the basic plane count twice."""
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+", " ")


def last_integer(text: Column) -> Column:
    """The last run of digits as a number; null without one or where it is 0."""
    found = F.regexp_extract(text, r"([0-9]{1,9})[^0-9]*$", 1)
    return F.nullif(F.when(found != "", found.cast("int")), F.lit(0))


ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text: Column) -> Column:
    """Value of a roman numeral in one case, without a check of its grammar; null for other text."""
    digits = F.split(F.lower(text), "(?!^)")
    value = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    values = F.transform(digits, lambda d: value[d])
    signed = F.transform(values, lambda x, i: F.when(x < F.coalesce(F.get(values, i + 1), F.lit(0)), -x).otherwise(x))
    return F.when(text.rlike("^([ivxlcdm]+|[IVXLCDM]+)$"), F.aggregate(signed, F.lit(0), lambda t, x: t + x))


def split_href(href: Column) -> tuple[Column, Column]:
    """(path, fragment or null), cut at the first '#'."""
    at = F.instr(href, "#")
    return F.when(at > 0, F.substring(href, F.lit(1), at - 1)).otherwise(href), F.when(at > 0, F.substring(href, at + 1, F.char_length(href)))


def resolve_path(path: Column) -> Column:
    """A path without '.', '..' and empty steps."""
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((x == ".") | (x == ""), done).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def rect_gap(a: list[Column], b: list[Column]) -> Column:
    """Distance between rectangles (x1, y1, x2, y2); 0 where they meet."""
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def chebyshev_gap(a: list[Column], b: list[Column]) -> Column:
    return F.greatest(a[0] - b[2], b[0] - a[2], a[1] - b[3], b[1] - a[3], F.lit(0.0))


def normalized(text: Column, form: str) -> Column:
    """Text in a Unicode normal form; only texts beyond ASCII leave the JVM."""

    @F.pandas_udf("string")
    def other(x: pd.Series) -> pd.Series:
        return x.str.normalize(form)

    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(F.coalesce(plain, F.lit(True)), text).otherwise(other(F.when(~plain, text)))


# Combining marks, blanks and dashes that count for nothing when texts are compared.
NOTHING = r"[\u0300-\u036f\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF\x2D\u058A\u05BE\u1400\u1806\u2010-\u2015\u2E17\u2E1A\u2E3A\u2E3B\u301C\u3030\u30A0\uFE31\uFE32\uFE58\uFE63\uFF0D]"


def normal_text(text: Column) -> Column:
    """Text without marks, blanks, dashes and case."""
    return F.lower(F.regexp_replace(normalized(text, "NFD"), NOTHING, ""))


def nearly_equal(a: Column, b: Column) -> Column:
    """Edit distance under a tenth of the first text's length, without blanks, dashes and case."""
    x, y = normal_text(a), normal_text(b)
    return F.levenshtein(x, y) < 0.1 * F.char_length(x)


def sort_index(page: Column, offset: Column, top: Column) -> Column:
    pad = lambda x, n: F.lpad(F.greatest(F.floor(x), F.lit(0)).cast("string"), n, "0")
    return F.concat_ws("|", pad(page, 5), pad(offset, 6), pad(top, 5))
