"""Outlines from headings: styles, numbering, a catalog's own outline and headings set inside paragraphs.

Styles, numbers and depths are column functions and aggregations; matching catalog titles to blocks and giving levels
depend on what came before, so they are folds over one document's headings. Null titles count as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Titles that always stand at the top, the form of a heading number, block types without headings.
TOP_TITLES = ("acknowledgments", "acknowledgements", "references", "bibliography")
NUMBER = r"^\s*((?:\d+|[A-Za-z]+)(?:[.-](?:\d+|[A-Za-z]+))*)(?=\s|[.)\-:]|$)"
NEVER_HEADINGS = ("note", "caption", "table", "image", "math")
LONGEST_HEADING, DEEPEST = 150, 6


def number_parts(title: Column) -> Column:
    """'1.2.3', 'A.1' or 'IV.2' at the beginning of a title as its parts; empty for words."""
    parts = F.split(F.regexp_extract(F.coalesce(title, F.lit("")), NUMBER, 1), "[.-]")
    ok = F.forall(parts, lambda p: p.rlike("^([0-9]+|[A-Za-z]|[IVXivx]{1,4})$"))
    return F.when(ok, parts).otherwise(F.array().cast("array<string>"))


def mostly_upper(title: Column) -> Column:
    """Whether at least 0.9 (to two places) of the characters are their own capitals."""
    same = F.size(F.filter(F.split(title, ""), lambda c: (c == F.upper(c)) & (c != "")))
    return F.coalesce(F.round(same / F.nullif(F.char_length(title), F.lit(0)), 2) >= 0.9, F.lit(False))


def font_name(font: Column) -> Column:
    """A font's name without the mark of a subset."""
    return F.trim(F.regexp_replace(F.coalesce(font, F.lit("")), r"^[^+]*\+(?=.)", ""))


def style(font: Column, size: Column, title: Column) -> Column:
    """Font, size in half points and case as one key."""
    return F.concat_ws("|", font_name(font), (F.floor(F.coalesce(size, F.lit(0)) * 2 + 0.5) / 2).cast("decimal(9,1)").cast("string"), mostly_upper(title).cast("string"))


# What a font's name says of its weight; the first word that fits counts.
WEIGHTS = (("black", 4.0), ("heavy", 3.5), ("bold", 3.0), ("demi", 2.5), ("medium", 2.0), ("regular", 1.0))
RARE_SHARE, FREQUENT_SHARE, SMALL_SHARE = 0.02, 0.35, 0.7


def font_weight(font: Column) -> Column:
    """A font's weight from 0 to 4, by its name."""
    name = F.lower(F.coalesce(font, F.lit("")))
    out = F.lit(0.0)
    for word, weight in reversed(WEIGHTS):
        out = F.when(F.contains(name, F.lit(word)), F.lit(weight)).otherwise(out)
    return out


def style_stats(headings: DataFrame, key: str) -> DataFrame:
    """key, style, size, upper, weight, n, place (from 0: larger, capital, heavier, rarer styles first), rare, frequent,
    small, size_gap (to the next style). headings: key, title, font, size. Null sizes are 0; ties in everything are
    ordered by the style's key."""
    half = (F.floor(F.coalesce("size", F.lit(0)) * 2 + 0.5) / 2).alias("size")
    x = headings.select(key, style(F.col("font"), F.col("size"), F.col("title")).alias("style"), half, F.coalesce("size", F.lit(0)).cast("double").alias("__exact"), mostly_upper(F.col("title")).alias("upper"), font_weight(font_name(F.col("font"))).alias("weight"))
    whole = x.groupBy(key).agg(F.count(F.lit(1)).alias("__all"), F.median("__exact").alias("__median"))
    per = x.groupBy(key, "style", "size", "upper", "weight").agg(F.count(F.lit(1)).alias("n")).join(whole, key)
    order = Window.partitionBy(key).orderBy(F.desc("size"), F.desc("upper"), F.desc("weight"), "n", "style")
    share = F.col("n") / F.col("__all")
    return per.select(
        key, "style", "size", "upper", "weight", "n", (F.row_number().over(order) - 1).alias("place"), ((F.col("n") <= 1) | (share < RARE_SHARE)).alias("rare"), (share > FREQUENT_SHARE).alias("frequent"),
        ((F.col("__median") > 0) & (F.col("size") < F.col("__median") * SMALL_SHARE)).alias("small"), F.coalesce(F.abs(F.col("size") - F.lead("size").over(order)), F.col("size")).alias("size_gap"),
    )


def inline_headings(blocks: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """Short blocks whose first character has a style that headings have, and that differs from the block's own.
    blocks: key, block, type, title, font, size, first_font, first_size; headings: key, block, title, font, size."""
    known = headings.select(key, style(F.col("font"), F.col("size"), F.col("title")).alias("__style")).distinct()
    own, first = style(F.col("font"), F.col("size"), F.col("title")), style(F.col("first_font"), F.col("first_size"), F.col("title"))
    fits = (F.col("title") != "") & (F.char_length("title") <= LONGEST_HEADING) & ~F.col("type").isin(*NEVER_HEADINGS)
    named = (font_name(F.col("first_font")) != "") | (F.coalesce("first_size", F.lit(0)) > 0)
    x = blocks.filter(fits & named & (own != first)).withColumn("__style", first)
    return x.join(known, [key, "__style"], "left_semi").join(headings.select(key, "block"), [key, "block"], "left_anti").drop("__style")


def _plain(title: str | None) -> str:
    return " ".join((title or "").lower().split())


def cut_title(block: str, native: str) -> str:
    """A block's text cut to about the length of the catalog's title, at the nearest blank within three characters."""
    n = len(native)
    if not n or len(block) <= n:
        return block
    blanks = [i for i in range(max(0, n - 3), min(len(block) - 1, n + 3) + 1) if block[i].isspace()]
    return block[: min(blanks, key=lambda i: abs(i - n), default=n)].strip()


def native_matches(native: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, block, title, depth: each catalog entry, in order, with the first block of its page that is still free and
    of which one's text begins with the other's. native: key, ord, page, title, depth; blocks: key, block, page, title."""
    entries = native.dropna(subset=["page"]).groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "depth"))).alias("entries"))
    texts = blocks.dropna(subset=["page"]).groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("block", "title"))).alias("texts"))

    def run(frames):
        for f in frames:
            out = []
            for k, wanted, offered in zip(f[key], f.entries, f.texts, strict=True):
                free = [(b["block"], b["title"] or "", _plain(b["title"])) for b in offered]
                for e in wanted:
                    name = _plain(e["title"])
                    hit = next((b for b in free if name and b[2] and (b[2].startswith(name) or name.startswith(b[2]))), None)
                    if hit:
                        free.remove(hit)
                        out.append((k, hit[0], cut_title(hit[1], e["title"]), e["depth"]))
            yield pd.DataFrame(out, columns=[key, "block", "title", "depth"])

    return entries.join(texts, [key, "page"]).mapInPandas(run, f"`{key}` {dict(native.dtypes)[key]}, block long, title string, depth int")


def style_depths(headings: DataFrame, native: DataFrame, key: str) -> DataFrame:
    """key, style, depth where a style's headings agree: by their numbers, else by the catalog (depth from 0).
    Styles whose numbers disagree have none. headings: key, style, parts; native: key, style, depth."""
    numbered = headings.filter(F.size("parts") > 0).groupBy(key, "style").agg(F.min(F.size("parts")).alias("least"), F.max(F.size("parts")).alias("most"))
    listed = native.groupBy(key, "style").agg(F.min("depth").alias("low"), F.max("depth").alias("high"))
    x = numbered.join(listed, [key, "style"], "full_outer")
    depth = F.when(F.col("least") == F.col("most"), F.col("least")).when(F.col("least").isNull() & (F.col("low") == F.col("high")), F.col("low") + 1)
    return x.select(key, "style", depth.cast("int").alias("depth")).filter("depth is not null")


def levelled(rows: list[dict]) -> list[tuple[int, int, int | None]]:
    """(block, level, parent) of headings in order; rows: block, style, n_parts, depth (of the style, 0 if it has none), top."""
    deepest = min(DEEPEST, max(1, len({r["style"] for r in rows})))
    path: list[int] = []  # indices of the open headings
    parent: list[int | None] = []
    at: list[int] = []
    for i, r in enumerate(rows):
        styles = [rows[k]["style"] for k in path]
        if r["top"]:
            level = 1
        elif r["n_parts"]:
            level = r["n_parts"]
        elif r["depth"] and r["style"] not in styles:
            level = r["depth"]
        elif i and rows[i - 1]["style"] == r["style"]:
            level = at[-1]
        else:
            level = styles.index(r["style"]) + 1 if r["style"] in styles else len(path) + 1
        level = int(min(max(level, 1), deepest, len(path) + 1))
        path = path[: level - 1]
        parent.append(path[-1] if path else None)
        at.append(level)
        path.append(i)
    # headings that alone have their style and hold others give way to those
    of_style = pd.Series([r["style"] for r in rows]).value_counts()
    holders = set(parent)
    passed = [of_style[r["style"]] == 1 and i in holders and not r["top"] for i, r in enumerate(rows)]
    out, level = [], {None: 0}
    for i, r in enumerate(rows):
        above = parent[i]
        while above is not None and passed[above]:
            above = parent[above]
        level[i] = level[above] + 1
        if not passed[i]:
            out.append((r["block"], level[i], None if above is None else rows[above]["block"]))
    return out


def heading_outline(headings: DataFrame, native: DataFrame, key: str) -> DataFrame:
    """key, block, title, level, parent (block). headings: key, block, page, y (top edge), title, font, size;
    native: key, style, depth. Order: page, from the top, block."""
    h = headings.withColumn("style", style(F.col("font"), F.col("size"), F.col("title"))).withColumn("parts", number_parts(F.col("title")))
    h = h.join(style_depths(h, native, key), [key, "style"], "left")
    top = F.coalesce(F.lower(F.trim("title")).isin(*TOP_TITLES), F.lit(False))
    item = F.struct(F.coalesce("page", F.lit(1 << 30)).alias("page"), (-F.coalesce("y", F.lit(0.0))).alias("y"), F.col("block").cast("long").alias("block"), "style", F.size("parts").alias("n_parts"), F.coalesce("depth", F.lit(0)).alias("depth"), top.alias("top"))
    gathered = h.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def run(frames):
        for f in frames:
            out = [(k, *x) for k, items in zip(f[key], f["items"], strict=True) for x in levelled(list(items))]
            frame = pd.DataFrame(out, columns=[key, "block", "level", "parent"])
            yield frame.assign(parent=frame["parent"].astype("Int64"))

    levels = gathered.mapInPandas(run, f"`{key}` {dict(headings.dtypes)[key]}, block long, level int, parent long")
    return levels.join(headings.select(key, F.col("block").cast("long").alias("block"), F.trim("title").alias("title")), [key, "block"])
