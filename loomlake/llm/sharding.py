"""Operator 1, sharding by fixed virtual slots (DataFrame functions only).

A record's id and text checksum are hashed into one of ``n_slots`` virtual slots, a number that never changes. Bytes are
summed per slot, and a versioned slot map says which shard owns which slot: version 0 deals the slots out evenly, and
each rebalancing makes a next version from the loads. Moving load means editing that map: no record is hashed again, and
only the edited slots move. The map has ``n_slots`` rows whatever the corpus holds, so it is folded in one row and joined
as a broadcast of proven size.

Defined results: a null id is hashed as 0x8000000000000000; a null text has size 1 and the CRC of no bytes; rows with one
id and different texts are spread over the slots; rows equal in id and text share a slot, or several where they are more
than a slot's share of all rows, and are numbered in any order; very long texts count with all their bytes; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import id_of, key_of, stash, text_of

N_SLOTS = 4096
MAX_SLOTS = 65536


def virtual_slot(n_slots: int = N_SLOTS) -> Column:
    """First 32 bits of the MD5 of the record's id, checksum and salt, modulo the slot count."""
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in ("k", "text_crc32", "salt")])
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def sized_records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """k, size, text_crc32, vslot of each row. Equal records that are more than a slot's share of all rows get salts."""
    text = text_of()
    rows = docs.select(key_of("doc_id").alias("k"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    equal = stash(rows.groupBy("k", "text_crc32", "size").count().where(F.col("count") > 1), "equal-records")
    most = -(-rows.count() // n_slots)
    hot = equal.where(F.col("count") > most).select("k", "text_crc32", "size", F.ceil(F.col("count") / F.lit(most)).alias("salts"))
    # fewer than n_slots groups: each has more than one n_slots-th of the rows. Which of equal rows has which salt is fixed when they are written
    salt = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")), F.lit(0))
    return rows.join(F.broadcast(hot), ["k", "text_crc32", "size"], "left").withColumn("salt", salt).withColumn("vslot", virtual_slot(n_slots)).select("k", "size", "text_crc32", "vslot")


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot; at most n_slots rows, summed before the shuffle."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def even_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: vslot, shard, version."""
    return spark.range(n_slots).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % n_shards).cast("int").alias("shard"), F.lit(0).alias("version"))


def edit_map(slot_map: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version for new loads or a new shard count. The slots are looked at from the largest down: one moves
    only from a shard above the mean to the least loaded one, and only if that narrows the gap; all others stay. Slots of
    shards that the count leaves out have to move."""
    slots = slot_map.select("vslot", F.col("shard").alias("old")).join(loads.select("vslot", "bytes"), "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "old")
    packed = slots.agg(F.sort_array(F.collect_list(F.struct("bytes", "vslot", "old")), asc=False).alias("s"))  # n_slots entries
    start = F.struct(
        F.expr(f"transform(sequence(0, {n_shards - 1}), i -> aggregate(filter(s, x -> x.old = i), 0L, (a, x) -> a + x.bytes))").alias("loads"),
        F.expr("cast(map() as map<int, int>)").alias("moved"),
    )
    mean = F.expr("aggregate(s, 0L, (a, x) -> a + x.bytes)") / n_shards

    def step(acc: Column, x: Column) -> Column:
        least = F.array_min(acc["loads"])
        to = (F.array_position(acc["loads"], least) - 1).cast("int")
        now = F.get(acc["loads"], x["old"])
        stays = now.isNotNull() & ((x["bytes"] == 0) | (now <= mean) | (now - x["bytes"] < least + x["bytes"]))
        after = F.transform(acc["loads"], lambda v, i: v + F.when(i == to, x["bytes"]).otherwise(0) - F.when(i == x["old"], x["bytes"]).otherwise(0))
        moved = F.struct(after.alias("loads"), F.map_concat(acc["moved"], F.create_map(x["vslot"], to)).alias("moved"))  # copied for slots that move, which are few
        return F.when(stays, acc).otherwise(moved)

    moves = packed.select(F.aggregate("s", start, step, lambda acc: acc["moved"]).alias("m")).select(F.explode("m").alias("vslot", "to"))
    edited = slot_map.join(F.broadcast(moves), "vslot", "left")  # n_slots rows at most
    return edited.select("vslot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version"))


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed rows, slot map). Placed: doc_id, size, text_crc32, vslot, shard, slot (place in the shard, from 0)."""
    if not 1 <= n_shards <= n_slots <= MAX_SLOTS:
        raise ValueError(f"1 <= n_shards <= n_slots <= {MAX_SLOTS} is needed")
    records = stash(sized_records(docs, n_slots), "shard-records")
    loads = stash(slot_loads(records), "shard-loads")
    slot_map = stash(edit_map(even_map(docs.sparkSession, n_shards, n_slots), loads, n_shards), "shard-map")
    return place(records, loads, slot_map), slot_map


def place(records: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Number rows without gaps in each shard: the place inside the virtual slot after the rows of the shard's slots
    before it. Windows over rows are as many as slots; the running sum is over the map's few rows."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.join(loads, "vslot").select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("vslot").orderBy("k", "text_crc32", "size")
    return (
        records.withColumn("n", F.row_number().over(inside))
        .join(F.broadcast(bases), "vslot")  # at most MAX_SLOTS rows of three numbers
        .select(id_of("k").alias("doc_id"), "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("n") - 1).alias("slot"))
    )
