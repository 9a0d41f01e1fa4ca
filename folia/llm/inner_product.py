"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are dealt into blocks by descending length, so that block 0 has the longest. The rotation is the right
singular basis of all vectors (eigenvectors of their d x d Gram matrix, summed by the executors), strongest direction
first. A query meets block 0 first, which gives it a threshold: its k-th best score so far. Every other block is
searched from long to short in chunks: a chunk, and so all that follow it, is left out as soon as query length times
vector length cannot reach the threshold; of the rest, the first HEAD rotated coordinates are multiplied, and only
vectors whose partial sum plus the product of the residual lengths reaches the threshold are multiplied in full. Full
products are of the unrotated whole numbers and so exact; rotated bounds get a slack for rounding.

Queries and vectors meet in pairs of blocks of bounded size. After block 0 the queries are dealt into blocks by the
length that a vector must have to reach their thresholds; a pair of blocks meets only if the vector block's longest is
long enough for the least demanding query of the other (`block_pairs`, a table with a row per pair of blocks). So whole
blocks of short vectors aren't sent to queries that cannot take them. Nothing is left out that could be in a result:
ties are kept until the final ranking.

Edge cases. Vectors that are null or hold null or non-finite components take no part. Vectors of unequal dimension
are compared as if padded with zeros. Null ids take no part. Rows that share an id count as one candidate with the best
of their scores, and as queries they are one query, that with the best scores. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, stored

BLOCK = 16384
QUERY_BLOCK = 4096
CHUNK = 512
HEAD = 16
MOST_BROADCAST_PAIRS = 1_000_000


def usable(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v, the whole-numbered components; only rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    out = np.zeros((len(column), d))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """d x d orthogonal matrix whose columns are the vectors' singular directions, strongest first."""

    def gram(frames):
        total = np.zeros((d, d))
        for f in frames:
            m = _matrix(f.v, d)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(d), "row": list(total)})

    sums = (
        vectors.select("v").mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
        .groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()  # d * d rows
    )
    m = np.zeros((d, d))
    m[np.asarray(sums["i"]), np.asarray(sums["j"])] = np.asarray(sums["x"])
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


def search_block(q_id, q, limit, c_id, c, k: int, turn: np.ndarray, head: int = HEAD) -> pd.DataFrame:
    """The best k of a block of vectors for each query of a block, as far as they reach the queries' limits."""
    length = np.sqrt((c**2).sum(1))
    order = np.lexsort((c_id, -length))
    c_id, c, length = c_id[order], c[order], length[order]
    qr, cr = q @ turn, c @ turn
    q_len, q_rest = np.sqrt((q**2).sum(1)), np.sqrt((qr[:, head:] ** 2).sum(1))
    c_rest = np.sqrt((cr[:, head:] ** 2).sum(1))
    limit = limit.copy()
    best: list[dict] = [{} for _ in q_id]
    alive = np.arange(len(q_id))
    for at in range(0, len(c_id), CHUNK):
        part = slice(at, at + CHUNK)
        slack = 1e-6 * (1 + q_len * length[at])
        alive = alive[(q_len[alive] * length[at] + slack[alive]) >= limit[alive]]
        if not len(alive):
            break
        bound = qr[alive, :head] @ cr[part, :head].T + np.outer(q_rest[alive], c_rest[part]) + slack[alive][:, None]
        for row, i in enumerate(alive):
            near = np.flatnonzero(bound[row] >= limit[i]) + at
            if not len(near):
                continue
            score = np.rint(c[near] @ q[i]).astype(np.int64)
            ids = c_id[near]
            keep = (score >= limit[i]) & (ids != q_id[i])
            mine = best[i]
            for s, x in zip(score[keep].tolist(), ids[keep].tolist(), strict=True):
                if x not in mine or mine[x] < s:
                    mine[x] = s
            if len(mine) >= k:
                top = sorted(mine.items(), key=lambda t: (-t[1], t[0]))[:k]
                best[i] = dict(top)
                limit[i] = max(limit[i], top[-1][1])
    rows = [(q_id[i], x, s) for i, mine in enumerate(best) for x, s in mine.items()]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: vec_id, v as usable() makes them."""
    spark = vectors.sparkSession
    found = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, d = found[0], max(1, found[1] or 1)
    n_q = queries.count()
    width = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(width, n // 1024))
    q_blocks = max(1, -(-n_q // query_block))
    turn = rotation(vectors, d)
    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    dealt = vectors.withColumn("length", F.sqrt(length)).repartitionByRange(blocks, F.desc("length"), "vec_id")
    by_length = stored(dealt.withColumn("block", F.spark_partition_id()), "vectors-by-length")
    longest = stored(by_length.groupBy("block").agg(F.max("length").alias("longest")), "block-lengths")
    first_block = longest.agg(F.min("block")).first()[0]
    asked = stored(queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q_block")), "queries")

    def meet(pairs: DataFrame, asked_part: DataFrame) -> DataFrame:
        pairs = broadcast_if(pairs, MOST_BROADCAST_PAIRS)
        left = by_length.join(pairs, "block").select("block", "q_block", "vec_id", "v")
        right = asked_part.join(pairs, "q_block").select("block", "q_block", "vec_id", "v", "limit")

        def both(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if c.empty or q.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            return search_block(q.vec_id.to_numpy(), _matrix(q.v, d), q.limit.to_numpy(float), c.vec_id.to_numpy(), _matrix(c.v, d), k, turn, min(HEAD, d))

        return left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block")).applyInPandas(both, "query_id long, vec_id long, score long")

    no_limit = asked.withColumn("limit", F.lit(float("-inf")))
    every_query = asked.select("q_block").distinct().withColumn("block", F.lit(first_block).cast("int"))
    first = stored(meet(stored(every_query, "first-pairs"), no_limit), "first-block")
    one = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    limits = one.withColumn("rank", place).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("known"))
    limited = asked.drop("q_block").join(limits, "vec_id", "left").withColumn("limit", F.coalesce("known", F.lit(float("-inf")))).drop("known")
    own = F.sqrt(length)
    limited = limited.withColumn("needed", F.when((F.col("limit") > 0) & (own > 0), F.col("limit") / own).otherwise(float("-inf")))
    limited = limited.repartitionByRange(q_blocks, F.desc("needed"), "vec_id").withColumn("q_block", F.spark_partition_id())
    limited = stored(limited, "queries-by-need")
    pairs = stored(block_pairs(longest.filter(F.col("block") > first_block), limited), "block-pairs") if first_block is not None else every_query
    every = first.unionByName(meet(pairs, limited))
    every = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return every.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_pairs(longest: DataFrame, queries: DataFrame) -> DataFrame:
    """block, q_block: the pairs in which a vector may reach a query's threshold. longest: block, longest; queries:
    q_block, needed (the length that a vector must have). Both are joined by block, a row per pair of blocks."""
    least = queries.groupBy("q_block").agg(F.min("needed").alias("needed"))
    numbers = longest.agg(F.min("block").alias("a"), F.max("block").alias("z")).first()
    if numbers.a is None:
        return least.select(F.lit(0).alias("block"), "q_block").limit(0)
    every = least.withColumn("block", F.explode(F.sequence(F.lit(numbers.a), F.lit(numbers.z))))
    return every.join(longest, "block").filter(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("needed")).select("block", "q_block")


def op9_inner_product(embeddings: DataFrame) -> DataFrame:
    vectors = stored(usable(embeddings), "vectors")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
