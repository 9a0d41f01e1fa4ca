"""Operators over ordered rows: islands, neighbours, running values, as-of look-ups, buckets. Each needs one exchange on
its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of the plan's estimate (files and columns that are read) that a task gets where rows are dealt by size.
PART_BYTES = 2_000_000


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """rows dealt by key to as many partitions as their size asks for, so that a task's memory doesn't grow with the
    input. Windows and groupings by the key, or by more than it, need no further exchange."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(-(-size // PART_BYTES), rows.sparkSession.sparkContext.defaultParallelism), *key)


def islands(rows: DataFrame, key: list[str], order: str, flag: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a run ends where flag changes."""
    w = Window.partitionBy(*key).orderBy(order)
    changed = F.when(~flag.eqNullSafe(F.lag(flag).over(w)), 1).otherwise(0)
    return rows.withColumn("__new", changed).withColumn(name, F.sum("__new").over(w)).drop("__new")


def outline_parents(rows: DataFrame, key: str, order: str, level: str, deepest: int = 6) -> DataFrame:
    """parent: order of the latest earlier row with a smaller level. One window, no self-join."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(order))).over(before) for k in range(1, deepest)]
    parent = F.greatest(*[F.when(F.lit(k) < F.col(level), x) for k, x in enumerate(last, 1)], F.lit(None).cast("long"))
    return rows.withColumn("parent", parent)


def offsets(rows: DataFrame, key: str, order: str, size: str, name: str = "start") -> DataFrame:
    """Sum of the sizes of all earlier rows."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str) -> DataFrame:
    """rows with the value of the last mark at or before them: union and running last value, no range join."""
    both = rows.withColumns({"__at": F.col(at), "__kind": F.lit(1), "__value": F.lit(None).cast(marks.schema[value].dataType)}).unionByName(
        marks.select(key, F.col(mark_at).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__value")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return dealt(both, key).withColumn(value, F.last("__value", ignorenulls=True).over(w)).filter("__kind = 1").drop("__at", "__kind", "__value")


def locations(rows: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """location: grows with the first row after which at least `limit` characters have gathered since the last growth.

    A sum with resets has no window form: a fold over each key's ordered sizes."""
    items = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("n")))).alias("items"))
    start = F.expr("named_struct('sum', 0L, 'at', 0, 'out', cast(array() as array<struct<o:bigint,location:int>>))")

    def step(s, x):
        full = s["sum"] >= limit
        at = s["at"] + F.when(full, 1).otherwise(0)
        return F.struct((F.when(full, F.lit(0).cast("long")).otherwise(s["sum"]) + x["n"]).alias("sum"), at.alias("at"),
                        F.concat(s["out"], F.array(F.struct(x["o"].cast("long").alias("o"), at.alias("location")))).alias("out"))

    return items.select(key, F.explode(F.aggregate("items", start, step)["out"]).alias("x")).select(key, F.col("x.o").alias(order), "x.location")


def even_buckets(rows: DataFrame, key: list[str], order: str, most: int) -> DataFrame:
    """bucket: rows dealt to at most `most` buckets; bucket i holds floor(i n / most) up to floor((i+1) n / most)."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    bucket = F.when(F.col("__n") <= most, F.col("__i")).otherwise(F.floor(((F.col("__i") + 1) * most - 1) / F.col("__n")))
    return ranked.withColumn("bucket", bucket.cast("int")).drop("__i", "__n")


def top_k(rows: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)


def majority_flow(flow: Column) -> Column:
    """The commonest of body, auxiliary, excluded; body wins ties, then auxiliary."""
    body, aux, out = (F.count_if(F.coalesce(flow, F.lit("body")) == x) for x in ("body", "auxiliary", "excluded"))
    return F.when((body >= aux) & (body >= out), "body").when(aux >= out, "auxiliary").otherwise("excluded")


def not_overlapping(new: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """New inclusive ranges (start, end) that overlap none that is held in the same key."""
    h = held.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("start").alias("__start"), F.col("end").alias("__end"))
    on = [new[c] == h[f"__{c}"] for c in key] + [new["start"] <= h["__end"], h["__start"] <= new["end"]]
    return new.join(h, on, "left_anti")


def keep_last_value(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last, at the place of the first (`place`)."""
    cols = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("x"), F.min(order).alias("place"))
    return last.select(*key, *[F.col(f"x.{c}") for c in cols], "place")
