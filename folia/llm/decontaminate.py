"""Benchmark decontamination with spaced seeds.

Texts become lower-cased runs of letters and digits. Two fixed masks of five positions select tokens from a sliding
span; the selected tokens' hashes of benchmark and documents are joined. Every hit names a diagonal (document position
less item position), and the tokens around it are compared along that diagonal: an overlap is a window of WINDOW
tokens of which at least ENOUGH are equal, so single substitutions are tolerated. The two masks together hit every
such window whatever its two unequal places are (checked over all placements in the tests).

Items shorter than WINDOW must match over their whole length, with as large a share of unequal tokens as the window
allows; those with fewer than TOLERANT tokens must occur token for token. An item with fewer tokens than the shortest
mask has no seed and matches nothing: so few words can't be told from chance.

Positions are generated, hashed and probed in one generated-code stage: no position is shuffled as long as the
benchmark's seeds fit the checked broadcast bound. Beyond it rows of document number, position and seed alone are
shuffled; the tokens are joined back for the diagonals that were hit.

Every diagonal is verified: hits are grouped by the operator's own row numbers of document and item and by the signed
start, so neither rows that share an id nor starts before a document's first token stand for one another.

Edge cases. Null or empty texts match nothing. A null doc_id is reported as null, a null item_id as null. Rows that
share an id are compared apart and reported once, by their best diagonal. Empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough, stored

MASKS = ("11111", "1101011")
WINDOW = 13
ENOUGH = 11
TOLERANT = 8
MOST_BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(toks: Column, at: Column) -> Column:
    """The hash of each mask at a position: null where its span passes the end."""
    out = []
    for k, mask in enumerate(MASKS):
        picked = [F.get(toks, at + i) for i, c in enumerate(mask) if c == "1"]
        out.append(F.when(at + len(mask) <= F.size(toks), F.xxhash64(F.lit(k), *picked)))
    return F.array(*out)


def seed_table(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, toks, at, seed: a row per mask and position."""
    shortest = min(map(len, MASKS))
    toks = texts.select(*keys, tokens(F.col("text")).alias("toks"))
    # no filter on the tokens: it would be pushed below and split every text twice
    at = F.when(F.size("toks") >= shortest, F.sequence(F.lit(0), F.size("toks") - shortest))
    spots = toks.select(*keys, "toks", F.explode(at).alias("at"))
    return spots.select(*keys, "toks", "at", F.explode(_seeds(F.col("toks"), F.col("at"))).alias("seed")).filter("seed is not null")


def _hits(docs: DataFrame, items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """doc_row, item_row, start, keys, item_id, toks, item: hit diagonals, some of them more than once."""
    seeds = seed_table(items, "item_row", "item_id").select("item_row", "item_id", F.col("toks").alias("item"), F.col("at").alias("item_at"), "seed")
    start = (F.col("at") - F.col("item_at")).alias("start")
    if small_enough(seeds, MOST_BROADCAST_SEEDS):
        numbered = docs.select(F.monotonically_increasing_id().alias("doc_row"), *keys, "text")
        return seed_table(numbered, "doc_row", *keys).join(F.broadcast(seeds), "seed").select("doc_row", "item_row", start, *keys, "item_id", "toks", "item")
    # the numbers must be the same in both readings
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("doc_row"), *keys, "text"), "leak-docs")
    items = stored(items, "leak-items")
    light = seed_table(items, "item_row").select("item_row", F.col("at").alias("item_at"), "seed")
    hit = seed_table(numbered, "doc_row").select("doc_row", "at", "seed").join(light, "seed").select("doc_row", "item_row", start).distinct()
    whole = hit.join(numbered.select("doc_row", *keys, tokens(F.col("text")).alias("toks")), "doc_row")
    return whole.join(items.select("item_row", "item_id", tokens(F.col("text")).alias("item")), "item_row")


def _by_row(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...], window: int = WINDOW, enough: int = ENOUGH, tolerant: int = TOLERANT) -> DataFrame:
    """keys (columns of docs), item_id, matched, aligned, best_window, doc_start: a row per diagonal with an overlap."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item_row"), "item_id", "text")
    hits = _hits(docs, items, keys)
    start = F.col("start")
    first = F.greatest(start, F.lit(0))
    # equal rows of a group have equal values: they are one diagonal of one document and item
    diagonals = hits.select(
        "doc_row", "item_row", "start", *keys, "item_id", F.size("item").alias("item_size"),
        F.slice("toks", first + 1, F.size("item") + F.least(start, F.lit(0))).alias("a"),
        F.slice("item", first - start + 1, F.size("item")).alias("b"),
    ).groupBy("doc_row", "item_row", "start").agg(*[F.first(c).alias(c) for c in (*keys, "item_id", "item_size", "a", "b")])
    diagonals = diagonals.withColumn("doc_start", F.greatest("start", F.lit(0)))
    equal = lambda k: F.when(F.get("a", k) == F.get("b", k), 1).otherwise(0)

    def slide(state, k):
        inside = state["inside"] + equal(k) - F.when(k >= window, equal(k - window)).otherwise(0)
        return F.struct(inside.alias("inside"), F.greatest(state["best"], inside).alias("best"), (state["total"] + equal(k)).alias("total"))

    nothing = F.struct(F.lit(0).alias("inside"), F.lit(0).alias("best"), F.lit(0).alias("total"))
    aligned = F.least(F.size("a"), F.size("b"))
    best = diagonals.select(
        *keys, "item_id", "doc_start", aligned.alias("aligned"), 
        F.when(F.col("item_size") < tolerant, F.col("item_size")).otherwise(F.ceil(F.least("item_size", F.lit(window)) * (enough / window))).alias("need"),
        F.aggregate(F.sequence(F.lit(0), aligned - 1), nothing, slide).alias("x"),
    ).select(*keys, "item_id", "doc_start", "aligned", "need", F.col("x.best").alias("best_window"), F.col("x.total").alias("matched"))
    return best.filter(F.col("best_window") >= F.col("need")).drop("need")


def overlaps(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id, item_id, matched (equal tokens on the best diagonal), aligned (tokens compared there),
    best_window (most equal tokens in a window), doc_start (first document token of that diagonal)."""
    return (
        _by_row(docs, benchmark, ("doc_id",), **kw)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("matched", "aligned", "best_window", (-F.col("doc_start")).alias("back"))).alias("m"))
        .select("doc_id", "item_id", "m.matched", "m.aligned", "m.best_window", (-F.col("m.back")).alias("doc_start"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents without an overlap. Rows that share an id are decided by their own texts; those whose id is null
    stay."""
    digest = "digest"
    while digest in docs.columns:
        digest += "_"
    # the text's digest and not a row number: a number would have to be the same in two readings of docs
    marked = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    bad = _by_row(marked.filter("doc_id is not null"), benchmark, ("doc_id", digest), **kw).select("doc_id", digest).distinct()
    return marked.join(bad, ["doc_id", digest], "left_anti").drop(digest)


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per contaminated document and item; documents without a row are clean."""
    return overlaps(docs, benchmark)


def needed(size: int) -> int:
    """Equal tokens that an item of this many tokens must show in its best window."""
    return size if size < TOLERANT else math.ceil(min(size, WINDOW) * (ENOUGH / WINDOW))
