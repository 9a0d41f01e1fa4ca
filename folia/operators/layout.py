"""Page layout from characters and line labels: monospace regions on a column grid, their overlay on blocks, the best
label sequence, blocks from labels.

Regions and blocks are windows and joins on the page; only the best label sequence is a fold, over one page's lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.operators.sequences import islands

# Shares and sizes of monospace regions.
MONO_SHARE, LEAST_LINES, GRID_SHARE, GRID_SLACK = 0.6, 3, 0.75, 0.2
PAGE = ["doc_id", "page"]


def mono_grid_regions(chars: DataFrame) -> DataFrame:
    """The regions of `mono_grid_lines`. chars: doc_id, page, line, ord, c, x1, x2, mono."""
    item = F.struct(*[F.col(c) for c in ("ord", "c", "x1", "x2", "mono")])
    return mono_grid_lines(chars.groupBy(*PAGE, "line").agg(F.collect_list(item).alias("chars")))


def mono_grid_lines(lines: DataFrame) -> DataFrame:
    """doc_id, page, first_line, last_line, n_lines, width, grid_share of runs of monospace lines whose characters stand
    on one grid of columns. lines: doc_id, page, line, chars (an array of ord, c, x1, x2, mono; a line without monospace
    characters may come with none, since no others can make it one of a run). Blank characters count nowhere; a page's line without a visible character ends a run. The column width is the commonest, of equals the
    first met; the first column is where the leftmost line begins.

    Characters never stand in rows of their own: a line weighs its own, and of monospace lines alone the places and the
    counts of widths go through the one exchange, by page."""
    visible = lambda x: F.coalesce(x["c"], F.lit("")).rlike(r"[^\s\p{Z}\x{feff}]")
    x = lines.withColumn("__in", F.filter("chars", lambda x: x["mono"] & visible(x)))
    x = x.withColumn("__seen", F.when(F.size("__in") > 0, F.filter("chars", visible)))
    is_mono = F.coalesce(F.size("__in") / F.size("__seen") >= MONO_SHARE, F.lit(False))
    placed = F.filter(F.transform("__seen", lambda x: F.struct(x["ord"].alias("ord"), x["x1"].alias("x1"))), lambda x: x["ord"].isNotNull())
    rounded = lambda x: F.struct((F.floor((x["x2"] - x["x1"]) * 100 + 0.5) / 100).alias("width"), x["ord"].alias("ord"))
    # arrays of one: expressions aren't moved past them, where those that stand inside of others would be made per item
    x = x.select(*PAGE, "line", F.explode(F.array(F.struct(
        is_mono.alias("is_mono"), F.when(is_mono, F.array_min(placed)["x1"]).alias("begin"), F.when(is_mono, F.filter(F.transform("__in", lambda x: x["x1"]), lambda v: v.isNotNull())).alias("xs"),
        F.when(is_mono, F.filter(F.transform("__in", rounded), lambda w: w["width"] > 0)).alias("ws")))).alias("__x")).select(*PAGE, "line", "__x.*")
    of = lambda w: F.filter("ws", lambda x: x["width"] == w)
    counted = F.transform(F.array_distinct(F.transform("ws", lambda x: x["width"])), lambda w: F.struct(w.alias("width"), F.size(of(w)).alias("n"), F.array_min(F.transform(of(w), lambda x: x["ord"])).alias("ord")))
    x = x.select(*PAGE, "line", "is_mono", "begin", "xs", counted.alias("widths"))
    runs = islands(x, PAGE, "line", F.col("is_mono")).filter("is_mono")
    met = F.transform("widths", lambda w: F.struct(w["width"].alias("width"), w["n"].alias("n"), F.col("line").alias("line"), w["ord"].alias("ord")))
    runs = runs.groupBy(*PAGE, "island").agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n_lines"), F.min("begin").alias("zero"),
        F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list(met)).alias("widths")).filter(F.col("n_lines") >= LEAST_LINES)
    same = lambda w: F.filter("widths", lambda x: x["width"] == w)
    rank = lambda w: F.struct(
        (-F.aggregate(same(w), F.lit(0), lambda n, x: n + x["n"])).alias("n"), F.array_min(F.transform(same(w), lambda x: F.struct(x["line"].alias("line"), x["ord"].alias("ord")))).alias("met"), w.alias("width"))
    width = F.array_min(F.transform(F.array_distinct(F.transform("widths", lambda x: x["width"])), rank))["width"]
    key = [*PAGE, "n_lines", "first_line", "last_line", "zero", "xs"]
    runs = runs.select(*key, F.explode(F.array(width)).alias("width")).filter("width is not null")
    column = lambda v: (v - F.col("zero")) / F.col("width")
    on_grid = F.filter("xs", lambda v: F.abs(column(v) - F.round(column(v))) < GRID_SLACK)
    fits = runs.select(*key, "width", F.explode(F.array(F.size(on_grid) / F.nullif(F.size("xs"), F.lit(0)))).alias("grid_share"))
    return fits.filter(F.col("grid_share") >= GRID_SHARE).select(*PAGE, "n_lines", "width", "first_line", "last_line", "grid_share")


def overlaid(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, page, start, end, type: blocks (the same columns) with preformatted regions (start, end) cut out of them.
    A block gives way to the first region that ends at or after its start, if the two overlap; of several blocks on a
    region the first brings it in. Ends are inclusive."""
    r = regions.select(*PAGE, F.col("start").alias("rs"), F.col("end").alias("re"))
    b = blocks.select(*PAGE, "start", "end", "type")
    met = b.join(r.withColumnsRenamed({c: f"__{c}" for c in PAGE}), [F.col(c) == F.col(f"__{c}") for c in PAGE] + [F.col("re") >= F.col("start")], "left").groupBy(*b.columns).agg(F.min(F.struct("rs", "re")).alias("r"))
    met = met.withColumns({"rs": F.col("r.rs"), "re": F.col("r.re")}).withColumn("hit", F.coalesce(F.col("rs") <= F.col("end"), F.lit(False)))
    order = Window.partitionBy(*PAGE, "hit", "rs").orderBy("start", "end")
    met = met.withColumn("nth", F.row_number().over(order))
    piece = lambda s, e, t: F.struct(F.col(s).alias("start") if isinstance(s, str) else s.alias("start"), F.col(e).alias("end") if isinstance(e, str) else e.alias("end"), t.alias("type"))
    hit = F.col("hit")
    pieces = F.array(
        F.when(~hit, piece("start", "end", F.col("type"))),
        F.when(hit & (F.col("start") < F.col("rs")), piece("start", F.col("rs") - 1, F.col("type"))),
        F.when(hit & (F.col("nth") == 1), piece("rs", "re", F.lit("preformatted"))),
        F.when(hit & (F.col("end") > F.col("re")), piece(F.col("re") + 1, "end", F.col("type"))),
    )
    return met.select(*PAGE, F.explode(F.array_compact(pieces)).alias("x")).select(*PAGE, "x.*")


def best_path(scores: np.ndarray, moves: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> list[int]:
    """The label sequence of the highest sum: a row's scores, the moves between neighbours (from, to), begin and finish."""
    if not len(scores):
        return []
    total, came = begin + scores[0], []
    for row in scores[1:]:
        ways = total[:, None] + moves
        came.append(ways.argmax(0))
        total = ways.max(0) + row
    path = [int((total + finish).argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return path[::-1]


def best_labels(rows: DataFrame, moves: list[list[float]], begin: list[float], finish: list[float]) -> DataFrame:
    """doc_id, page, line, label: the best sequence of every page. rows: doc_id, page, line, scores (one per label).
    The parameters are small, of labels alone."""
    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "scores"))).alias("rows"))
    m, b, e = np.array(moves, float), np.array(begin, float), np.array(finish, float)

    def run(frames):
        for f in frames:
            out = []
            for doc, page, lines in zip(f.doc_id, f.page, f["rows"], strict=True):
                labels = best_path(np.array([list(x["scores"]) for x in lines], float), m, b, e)
                out += [(doc, page, x["line"], k) for x, k in zip(lines, labels, strict=True)]
            yield pd.DataFrame(out, columns=[*PAGE, "line", "label"])

    types = dict(rows.dtypes)
    return pages.mapInPandas(run, f"doc_id {types['doc_id']}, page {types['page']}, line {types['line']}, label int")


def label_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, page, block, base, first_line, last_line, n_lines: a line goes on its predecessor's block if it continues
    one of the same base. lines: doc_id, page, line, base, continues."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    goes_on = F.coalesce(F.col("continues") & F.lag("base").over(w).eqNullSafe(F.col("base")) & F.lag("line").over(w).isNotNull(), F.lit(False))
    x = lines.withColumn("__new", (~goes_on).cast("int")).withColumn("block", F.sum("__new").over(w) - 1)
    return x.groupBy(*PAGE, "block", "base").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n_lines"))
