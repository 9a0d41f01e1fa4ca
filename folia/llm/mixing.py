"""Mixing sources to target weights.

Words are counted per source, every source gets a target, and a document is emitted floor(rate) times plus one more
with a probability equal to the fraction, drawn from a hash of seed, id and text. No order, no state: reruns agree.
There are DRAWS independent seeds; each source uses the one whose words come nearest its target, so that a small source
isn't left to one seed's luck. The choice is among whole draws, so a copy's probability leaves the fraction where one
document is a large part of its source (the README has figures); with many documents it doesn't.

Targets: sources in code point order (null last) take the given weights in turn and share share_pct percent of all
words. None exceeds cap times its source's size; what is above goes to the others by weight, which is water filling:
sources sorted by cap / weight fill first, the rest share what is left in proportion to their weights.

Edge cases. A null text has 0 words. A null source is a source of its own. Rows equal in doc_id and text share a draw.
An empty table, or one without words, gives targets 0 and no copies. Other columns pass through untouched where
documents are emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if, stored

WEIGHTS = (3, 1, 2)
SHARE_PCT = 150
CAP = 2
SEED = "mix-1"
DRAWS = 16
MOST_BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Hexadecimal digits that depend on the seed, the id and the text alone."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(key.cast("binary"))


def draw(digits: Column, k) -> Column:
    """The k-th draw (from 1) of the digits, in [0, 1): a hash of its own for each k."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.conv(F.substring(F.md5(F.concat(digits, k.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = SHARE_PCT, cap: int = CAP) -> DataFrame:
    """source, source_size, target, rate from rows of source and size: one small row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))).cast("int") + 1)
    every = Window.partitionBy()
    fill = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = (
        per.withColumn("weight", weight)
        .withColumn("most", (F.col("source_size") * cap).cast("double"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share_pct)) / 100.0)
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("full_before", F.coalesce(F.sum("most").over(fill), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    )
    full = F.col("weight") * (F.col("total") - F.col("full_before")) >= F.col("most") * (F.col("all_weight") - F.col("weight_before"))
    x = x.withColumn("full", full)
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * left / open_weight)
    return x.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0).alias("rate"),
    )


def _join(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = broadcast_if(plan.withColumnRenamed("source", "plan_source"), MOST_BROADCAST_SOURCES)
    return rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"])).drop("plan_source")


def copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan_of(light: DataFrame, **kw) -> DataFrame:
    """source, source_size, target, rate, k (the source's draw) from rows of source, size and digits."""
    first = stored(targets(light.select("source", "size"), **kw), "mix-targets")
    tried = _join(light.select("source", "size", "digits"), first.select("source", "rate")).groupBy("source").agg(
        *[F.sum(F.col("size") * copies(F.col("rate"), draw(F.col("digits"), k))).alias(f"taken{k}") for k in range(1, DRAWS + 1)]
    ).withColumnRenamed("source", "tried_source")
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"taken{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(1, DRAWS + 1)]))["k"]
    both = first.join(tried, first["source"].eqNullSafe(tried["tried_source"]))
    return stored(both.select("source", "source_size", "target", "rate", nearest.alias("k")), "mix-plan")


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed documents, each as many times as the mix takes it, with the input's columns. Texts aren't shuffled."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "source", digest(F.col("doc_id"), F.col("text")).alias("digits"))
    light = stored(docs.select("source", words(F.col("text")).alias("size"), digest(F.col("doc_id"), F.col("text")).alias("digits")), "mix-sizes")
    n = copies(F.col("rate"), draw(F.col("digits"), F.col("k")))
    taken = _join(boxed, plan_of(light, **kw).select("source", "rate", "k")).withColumn("n", n).filter("n > 0")
    return taken.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("copy")).select("doc.*")


def op3_mixing(docs: DataFrame) -> DataFrame:
    light = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), digest(F.col("doc_id"), F.col("text")).alias("digits")), "mix-sizes")
    x = _join(light, plan_of(light)).withColumn("copies", copies(F.col("rate"), draw(F.col("digits"), F.col("k"))))
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS digits FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight, CAST(source_size * 2 AS DOUBLE) AS most FROM s),
x AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 150.0::DOUBLE / 100.0::DOUBLE AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(most) OVER f, 0) AS full_before, coalesce(sum(weight) OVER f, 0) AS weight_before FROM w
    WINDOW f AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, weight * (total - full_before) >= most * (all_weight - weight_before) AS full_up FROM x),
z AS (SELECT source, source_size, CASE WHEN full_up THEN most ELSE weight * (total - sum(CASE WHEN full_up THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER () END AS target FROM y),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0 END AS rate FROM z),
t AS (SELECT r.source, k, any_value(target) AS target, sum(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5(digits || CAST(k AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)) AS taken
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT CAST(unnest(range(1, 17)) AS INTEGER) AS k) GROUP BY ALL),
b AS (SELECT source, k FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(taken - target), k) = 1),
c AS (SELECT d.*, source_size, target, CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5(digits || CAST(k AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM c
"""
