"""Sharding by fixed virtual slots.

A record hashes into one of a few thousand slots for ever; a small table maps slots to shards.
Bytes are summed per slot, and rebalancing edits the map, never the hash: a new version holds only
the slots that moved. Everything is DataFrame expressions; the map has ``slots`` rows at any size.

Defined results: a null text has size 1 and the CRC of no bytes; a null key hashes like any other
value together with the text's CRC, so many of them spread over the slots; equal rows share a
slot and take neighbouring positions; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.registry import documents, query
from tickloom.session import fresh_path, materialize

SLOTS = 4096


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Key, size, text CRC and virtual slot of every record, without its text."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(
        F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """Bytes and records per virtual slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt round robin."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"),
        F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def current_map(store: DataFrame, version: int | None = None) -> DataFrame:
    """The map as of a version: the last edit of every slot."""
    known = store if version is None else store.filter(F.col("version") <= version)
    return known.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def rebalanced(store: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """Edits that even out the bytes, as the next version (only slots that move).

    Every shard keeps its largest slots up to the mean load; the others go, largest first, to
    the shard with the least bytes. Shards beyond ``shards`` are emptied, new ones are filled.
    """
    slots = current_map(store).join(loads, "virtual_slot", "left").select(
        "virtual_slot", F.col("shard").alias("old"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = Window.partitionBy("old").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(
        Window.unboundedPreceding, 0)
    fitted = slots.withColumn("mean", F.sum("bytes").over(
        everywhere.partitionBy(F.lit(0))) / shards).withColumn(
        "stays", (F.col("old") < shards) & (F.sum("bytes").over(running) <= F.col("mean")))
    start = ", ".join(f"coalesce(sum(bytes) filter (where stays and old = {s}), 0L)" for s in range(shards))
    packed = fitted.agg(
        F.expr(f"array({start})").alias("loads"),
        F.sort_array(F.expr("collect_list(struct(bytes, -virtual_slot as slot)) filter (where not stays)"),
                     asc=False).alias("moving"))
    dealt = packed.select("moving", F.expr("""
        aggregate(moving, struct(loads as loads, cast(array() as array<int>) as targets), (a, x) -> struct(
            transform(a.loads, (v, i) -> if(i + 1 = array_position(a.loads, array_min(a.loads)),
                                            v + x.bytes, v)) as loads,
            concat(a.targets, array(cast(array_position(a.loads, array_min(a.loads)) - 1 as int))) as targets),
            a -> a.targets)""").alias("targets"))
    moved = dealt.select(F.inline(F.arrays_zip("moving", "targets"))).select(
        (-F.col("moving.slot")).cast("int").alias("virtual_slot"), F.col("targets").alias("shard"))
    version = store.agg(F.max("version") + 1).first()[0]
    return moved.join(slots, "virtual_slot").filter(F.col("shard") != F.col("old")).select(
        F.lit(version).alias("version"), "virtual_slot", "shard")


def assigned(rows: DataFrame, store: DataFrame, loads: DataFrame) -> DataFrame:
    """Shard of every record and its gapless position there.

    Positions are counted inside a virtual slot and shifted by the records of the shard's earlier
    slots, so no task sorts a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(
        Window.unboundedPreceding, -1)
    places = current_map(store).join(loads, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return rows.join(F.broadcast(places), "virtual_slot").withColumn(
        "slot", F.col("base") + F.row_number().over(inside) - 1)


def write_map(spark: SparkSession, loads: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """Store version 1 and the rebalanced version 2 under ``path``; return the stored table."""
    first_map(spark, shards, slots).coalesce(1).write.parquet(path)
    rebalanced(spark.read.parquet(path), loads, shards).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards of nearly equal bytes."""
    rows = materialize(sized(documents(spark, sf_dir)), "sized")
    loads = materialize(slot_loads(rows), "slots")
    store = write_map(spark, loads, 16, fresh_path(spark, "slot-map"))
    return assigned(rows, store, loads).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot")
