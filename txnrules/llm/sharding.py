"""Sharding by fixed virtual slots. DataFrame functions only.

Records are hashed into SLOTS virtual slots that never change. Bytes are added up per slot, and a versioned
map says which shard each slot is on. Version 1 deals the slots out in turn. `rebalance` and `grow` edit the
map: they read the bytes per slot (SLOTS rows, whatever the input) and write a new version in which only the
slots that must move have moved. Records themselves are never sorted or gathered by shard; the position of a
row in its shard comes from counts per (slot, part) plus a row number inside that small part.

Nulls: a null text has size 1 and checksum 0; a null id is hashed as the null it is, together with the text.
Repeated rows (same id and text) share a slot, and each keeps its own row and position. An empty table gives
an empty result. Other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrules.llm.runtime import cut, shared_folder, table

SLOTS = 4096
PARTS = 16  # of a slot, for numbering rows
MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per record: key, size in bytes, checksum, virtual slot and the part of the slot that numbers it."""
    mixed = F.xxhash64(F.col(key), F.col(text))
    return docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        F.pmod(mixed, F.lit(slots)).cast("int").alias("vslot"),
        F.pmod(F.shiftright(mixed, 32), F.lit(PARTS)).cast("int").alias("part"),
    )


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes of every slot, empty ones included: always `slots` rows."""
    spark = rows.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("vslot"))
    used = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    return every.join(used, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def first_map(per_slot: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots dealt out in turn."""
    return per_slot.select(F.lit(1).alias("version"), "vslot", (F.col("vslot") % shards).cast("int").alias("shard"), "bytes")


def _edited(current: DataFrame, shards: int, loads: str, choose: str, moved: str) -> DataFrame:
    """Fold over the slots, largest first, in SQL: a.loads starts as `loads`, `choose` gives the shard s of slot x, `moved` the loads after it.

    The fold holds one row per slot, a fixed number, so one task does it whatever the input.
    """
    listed = current.groupBy().agg(
        F.max("version").alias("version"),
        F.sum("bytes").alias("total"),
        F.expr("array_sort(collect_list(struct(-bytes AS neg, vslot, shard)))").alias("xs"),
        *[F.coalesce(F.sum(F.when(F.col("shard") == k, F.col("bytes"))), F.lit(0)).cast("long").alias(f"load{k}") for k in range(shards)],
    )
    folded = F.expr(f"""
        aggregate(
            xs,
            named_struct('loads', {loads}, 'out', CAST(array() AS array<struct<vslot:int,shard:int,bytes:bigint>>)),
            (a, x) -> transform(array({choose}), s -> named_struct(
                'loads', {moved},
                'out', concat(a.out, array(struct(x.vslot AS vslot, s AS shard, -x.neg AS bytes)))))[0]
        ).out""")
    edited = listed.select((F.col("version") + 1).alias("version"), F.explode(folded).alias("o"))
    return edited.select("version", "o.vslot", "o.shard", "o.bytes")


def rebalance(current: DataFrame, shards: int) -> DataFrame:
    """Next version with near-equal bytes: a slot stays where it is while its shard has room below the mean; otherwise it goes to the least loaded shard."""
    return _edited(
        current,
        shards,
        loads=f"array_repeat(0L, {shards})",
        choose=f"IF(a.loads[x.shard] - x.neg <= total / {shards}, x.shard, CAST(array_position(a.loads, array_min(a.loads)) - 1 AS INT))",
        moved="transform(a.loads, (l, i) -> IF(i = s, l - x.neg, l))",
    )


def grow(current: DataFrame, shards: int) -> DataFrame:
    """Next version with one more shard, the one numbered `shards`: slots move into it alone, from shards that stay at or above the new mean."""
    mean = f"total / {shards + 1}"
    return _edited(
        current,
        shards,
        loads=f"array({', '.join(f'load{k}' for k in range(shards))}, 0L)",
        choose=f"IF(a.loads[x.shard] + x.neg >= {mean} AND a.loads[{shards}] - x.neg <= {mean}, {shards}, x.shard)",
        moved="transform(a.loads, (l, i) -> l + IF(i = s, -x.neg, 0L) - IF(i = x.shard, -x.neg, 0L))",
    )


def store_map(version: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier versions stay readable."""
    version.select("vslot", "shard", "bytes", "version").write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The given version of the stored map, or the latest."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    wanted = F.lit(version) if version is not None else F.max("version").over(Window.partitionBy())
    return stored.withColumn("wanted", wanted).filter("version = wanted").select("version", "vslot", "shard", "bytes")


def shard(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows (of `hashed`) with their shard and a gapless position in it, from 0."""
    counts = rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).join(slot_map.select("vslot", "shard"), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("vslot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("vslot", "part").orderBy("key", "crc", "size")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["vslot", "part"]).select("key", "size", "crc", "vslot", "shard", (F.col("start") + F.col("nth")).alias("position"))


def op6_virtual_slots(spark, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 7, sizes near equal."""
    rows = cut(hashed(table(spark, sf_dir, "documents")))
    path = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    store_map(first_map(slot_bytes(rows), 8), path)
    store_map(rebalance(load_map(spark, path, 1), 8), path)
    return shard(rows, load_map(spark, path, 2)).select(
        F.col("key").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )
