"""Shards by fixed virtual slots.

Records hash into a fixed number of virtual slots. Only bytes per slot decide the layout: a versioned map says which
shard owns a slot, and rebalancing edits that map, so records move only where their slot does. All lists that meet in
one row have at most one entry per virtual slot (a constant), whatever the input; hot ids or texts spread over slots,
because both are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLOTS = 4096


def slot_of(id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("int")


def slot_bytes(rows: DataFrame, slot: str = "virtual_slot", size: str = "size") -> DataFrame:
    """``virtual_slot``, ``bytes``: one row per slot in use."""
    return rows.groupBy(F.col(slot).alias("virtual_slot")).agg(F.sum(size).alias("bytes"))


def _placed(waiting: DataFrame, loads: DataFrame) -> DataFrame:
    """Largest slot first, each to the shard with the least bytes so far (smaller shard on ties).

    ``waiting``: virtual_slot, bytes. ``loads``: shard, load. Both are bounded by the number of slots.
    """
    least = lambda state: (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
    step = lambda state, x: F.struct(
        F.transform(state["loads"], lambda v, i: v + F.when(i == least(state), x["bytes"]).otherwise(0)).alias("loads"),
        F.concat(state["out"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), least(state).alias("at")))).alias("out"))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))),
        lambda x: F.struct((-x["less"]).alias("bytes"), x["virtual_slot"].alias("virtual_slot")))
    start = loads.agg(F.array_sort(F.collect_list(F.struct("shard", "load"))).alias("start")).select("start").scalar()
    listed = waiting.agg(ordered.alias("slots")).withColumn("start", start)
    zero = F.struct(F.transform("start", lambda s: s["load"]).alias("loads"),
                    F.array().cast("array<struct<virtual_slot:int,at:int>>").alias("out"))
    placed = listed.select("start", F.aggregate("slots", zero, step)["out"].alias("out")).select("start", F.explode("out").alias("x"))
    return placed.select("x.virtual_slot", F.element_at("start", F.col("x.at") + 1)["shard"].alias("shard"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: ``version, virtual_slot, shard``. Slots without records are listed on first use."""
    loads = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("load"))
    return _placed(sizes, loads).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map``: slots leave shards that hold more than an equal share or that are gone, and
    fill the rest; all others stay. Works for growth, shrinking and drifted sizes."""
    latest = slot_map.where(F.col("version") == slot_map.agg(F.max("version")).scalar())
    sized = sizes.join(latest.select("virtual_slot", "shard"), "virtual_slot", "left")
    target = F.ceil(sizes.agg(F.sum("bytes")).scalar() / shards)
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")  # at most one row per virtual slot
    held = sized.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = held.withColumn("stays", F.coalesce((F.col("shard") < shards) & (F.col("upto") <= target), F.lit(False)))
    stays = held.where("stays")
    ids = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = ids.join(stays.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").select("shard", F.coalesce("load", F.lit(0).cast("long")).alias("load"))
    moved = _placed(held.where("not stays").select("virtual_slot", "bytes"), loads)
    version = F.coalesce(slot_map.agg(F.max("version")).scalar(), F.lit(0)) + 1
    return stays.select("virtual_slot", "shard").unionByName(moved).select(version.alias("version"), "virtual_slot", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    stored = spark.read.parquet(path).select(F.col("version").cast("int").alias("version"), "virtual_slot", "shard")
    return stored.where(F.col("version") == (F.lit(version) if version else stored.agg(F.max("version")).scalar()))


def sharded(docs: DataFrame, shards: int = 8, slot_map: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``,
    ``virtual_slot``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1; sizes of shards are near equal (law ``bytes``).
    ``slot`` numbers the rows of a shard from 0, by virtual slot, id, checksum (rows equal in all of these are
    interchangeable). Null ids hash as nulls. Numbering needs no task that holds a shard: rows are numbered inside
    their virtual slot, and slots start where the slot before ends. No rows in, no rows out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        slot_of(id_col, text_col, slots).alias("virtual_slot"))
    sizes = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    owners = slot_map if slot_map is not None else first_map(sizes.select("virtual_slot", "bytes"), shards)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(owners.select("virtual_slot", "shard"), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "crc", "size"))
    placed = rows.withColumn("nth", inside).join(F.broadcast(starts), "virtual_slot")  # at most one row per virtual slot
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
