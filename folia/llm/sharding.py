"""Sharding through fixed virtual slots.

Records are hashed into a fixed number of slots, far more than there are shards. Bytes and rows are summed per slot,
and a slot-to-shard map places the slots greedily, heaviest first, on the lightest shard. The map is a small versioned
table; rebalancing edits it and leaves the records' slots alone.

Rows with equal texts are a group only in that they have one text_crc32: each is placed by its id as well, so a group
with a third of all rows is spread over all slots and shards.

Edge cases. A null text has no bytes and size 1. A null doc_id is hashed with the text's checksum only. Rows repeated
in full fall into one slot and take neighbouring positions. An empty table gives no rows and a map of empty slots.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored

N_SLOTS = 4096


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: one light row per document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_loads(slotted: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows for every slot, empty ones included."""
    sums = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = slotted.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def _place(slots: DataFrame, first_loads: DataFrame | None, n_shards: int) -> DataFrame:
    """virtual_slot, shard: heaviest slot first, each to the shard with the least bytes so far (ties: lower number).

    The fold runs over one row that holds all slots; their number is fixed, so it doesn't grow with the data."""
    queue = slots.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), F.col("virtual_slot")))).alias("queue")
    )
    if first_loads is None:
        one = queue.withColumn("loads", F.array_repeat(F.lit(0).cast("long"), n_shards))
    else:
        known = first_loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("known"))
        one = queue.crossJoin(F.broadcast(known)).withColumn(
            "loads",
            F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.coalesce(F.col("known")[i], F.lit(0).cast("long"))),
        )

    def step(state, item):
        to = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: x - F.when(i == to, item["neg"]).otherwise(F.lit(0).cast("long"))).alias("loads"),
            F.concat(state["placed"], F.array(F.struct(item["virtual_slot"].alias("virtual_slot"), to.cast("int").alias("shard")))).alias("placed"),
        )

    start = F.struct(F.col("loads"), F.expr("cast(array() as array<struct<virtual_slot:int,shard:int>>)").alias("placed"))
    return one.select(F.explode(F.aggregate("queue", start, step)["placed"]).alias("x")).select("x.virtual_slot", "x.shard")


def _with_offsets(placed: DataFrame, loads: DataFrame, version: int) -> DataFrame:
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(loads, "virtual_slot").select(
        "virtual_slot", "shard", "bytes", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.lit(version).alias("map_version"),
    )


def first_map(loads: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the slot-to-shard map, with each slot's first position in its shard."""
    return _with_offsets(_place(loads, None, n_shards), loads, 1)


def rebalance(old: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map for new loads or another number of shards.

    A shard keeps its slots, heaviest first, as long as they fit into the new mean; only the rest, and the slots of
    shards that no longer exist, are placed anew."""
    version = old.agg(F.max("map_version")).first()[0] + 1
    now = old.select("virtual_slot", "shard").join(loads, "virtual_slot")
    mean = (loads.agg(F.sum("bytes")).first()[0] or 0) / n_shards
    so_far = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    marked = stored(now.withColumn("stays", (F.col("shard") < n_shards) & ((so_far <= mean) | (F.col("bytes") == 0))), "slot-marks")
    stays = marked.filter("stays").select("virtual_slot", "shard")
    kept = marked.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    moved = _place(marked.filter("not stays"), kept, n_shards)
    return _with_offsets(stays.unionByName(moved), loads, version)


def save_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Adds a version to the map table at path; versions that are there stay as they are."""
    slot_map.write.mode("append").partitionBy("map_version").parquet(path)
    return load_map(slot_map.sparkSession, path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the latest if none is given."""
    every = spark.read.parquet(path)
    latest = every.agg(F.max("map_version")).first()[0] if version is None else version
    return every.filter(F.col("map_version") == latest)


def shard(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Each document's shard and its position in the shard.

    Result: doc_id, size, text_crc32, virtual_slot, shard, slot (position in the shard, gapless from 0), map_version.
    Only light rows are shuffled, by slot; the map that is broadcast has n_slots rows."""
    spark = docs.sparkSession
    slotted = with_slots(docs, n_slots)
    slot_map = save_map(first_map(stored(slot_loads(slotted, n_slots), "slot-loads"), n_shards), path or new_path(spark, "slot-map"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = slotted.withColumn("rank", rank.cast("long"))
    return ranked.join(F.broadcast(slot_map.select("virtual_slot", "shard", "offset", "map_version")), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("offset") + F.col("rank")).alias("slot"), "map_version"
    )


def op1_sharding(docs: DataFrame) -> DataFrame:
    """The query's columns for 16 shards, under the law that their bytes are near equal."""
    return shard(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
