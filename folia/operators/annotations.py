"""Annotations: keys, differences, geometry, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.scalars import rect_gap, round_half_up

from .sequences import keep_last_value

KEY = ["type", "page_index", "x1", "y1", "x2", "y2", "comment"]


def deduplicated(annotations: DataFrame, order: str, key: list[str] | None = None) -> DataFrame:
    """Equal annotations once: the last value at the first place."""
    return keep_last_value(annotations, key or KEY, order)


def imported(current: DataFrame, existing: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Current annotations that aren't among the existing ones; null keys are equal."""
    return _without(current, existing, key or KEY)


def deleted(current: DataFrame, existing: DataFrame, key: list[str] | None = None) -> DataFrame:
    return _without(existing, current, key or KEY)


def _without(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    other = b.select(*[F.col(c).alias(f"__{c}") for c in key])
    on = [a[c].eqNullSafe(other[f"__{c}"]) for c in key]
    return a.join(other, on, "left_anti")


def rotated(rotation: Column, degrees: int) -> Column:
    """Degrees added; only a sum beyond 360 is reduced, 360 itself stays."""
    total = rotation + degrees
    return F.when(total > 360, total % 360).otherwise(total)


def third_party(notes: DataFrame, side: float = 22.0) -> DataFrame:
    """Notes with a 1-based page and a point as rectangles on a 0-based page, rounded to three places."""
    return notes.select(
        "id", "type", (F.col("page") - 1).alias("page_index"),
        *[round_half_up(x, 3).alias(n) for n, x in (("x1", F.col("x") - side / 2), ("y1", F.col("y") - side / 2), ("x2", F.col("x") + side / 2), ("y2", F.col("y") + side / 2))],
    )


def covered_range(highlights: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """first and last offset of the cells whose centre lies in a highlight (id, key, x1..y2)."""
    h = highlights.select("id", *[F.col(c).alias(f"__{c}") for c in key], *[F.col(c).alias(f"h{c}") for c in ("x1", "y1", "x2", "y2")])
    cx, cy = (cells["x1"] + cells["x2"]) / 2, (cells["y1"] + cells["y2"]) / 2
    on = [cells[c] == h[f"__{c}"] for c in key] + [cx >= h["hx1"], cx <= h["hx2"], cy >= h["hy1"], cy <= h["hy2"]]
    return h.join(cells, on).groupBy("id").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))


def closest(points: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """The nearest cell's offset for each rectangle (id, key, x1..y2), the first of equals."""
    p = points.select("id", *[F.col(c).alias(f"__{c}") for c in key], *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    gap = rect_gap([F.col(f"p{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("x1", "y1", "x2", "y2")])
    joined = p.join(cells, [cells[c] == p[f"__{c}"] for c in key])
    return joined.groupBy("id").agg(F.min(F.struct(gap.alias("gap"), "offset")).alias("x")).select("id", "x.offset", F.round("x.gap", 6).alias("gap"))


def without_pages(pages: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Pages that stay, with new gapless numbers."""
    from pyspark.sql import Window

    left = pages.join(removed.select(key, "page_index").distinct(), [key, "page_index"], "left_anti")
    return left.withColumn("new_index", F.row_number().over(Window.partitionBy(key).orderBy("page_index")) - 1)
