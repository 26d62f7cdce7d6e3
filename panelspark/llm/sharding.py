"""Shards through fixed virtual slots and a versioned slot-to-shard map, in DataFrame operations only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import column_like, cut_lineage

#: Number of virtual slots; fixed for the life of a store, and the proven size of every slot table.
SLOTS = 4096


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record: a hash of its key, the same for ever."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame, slot: str, size: str) -> DataFrame:
    """Bytes and rows of every used slot; partial sums go into the shuffle, at most ``SLOTS`` rows come out."""
    return records.groupBy(F.col(slot).alias("virtual_slot")).agg(F.sum(size).alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map: slots, the largest first, each to the shard that has least so far.

    The fold runs over one array of at most ``SLOTS`` entries, whatever the number of records.
    """
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("slot_bytes")).alias("b"), F.col("virtual_slot").alias("s"),
                                                   F.col("slot_rows").alias("n"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def place(state: Column, entry: Column) -> Column:
        at = F.array_position(state["load"], F.array_min(state["load"]))
        load = F.transform(state["load"], lambda x, i: F.when(i + 1 == at, x - entry["b"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(state["to"], F.array((at - 1).cast("int"))).alias("to"))

    one = sizes.groupBy().agg(ordered.alias("slots")).withColumn("to", F.aggregate("slots", start, place, lambda s: s["to"]))
    pair = F.explode(F.arrays_zip("slots", "to")).alias("p")
    return one.select(pair).select(F.lit(0).alias("version"), F.col("p.slots.s").alias("virtual_slot"), F.col("p.to").alias("shard"),
                                   (-F.col("p.slots.b")).alias("slot_bytes"), F.col("p.slots.n").alias("slot_rows"))


def all_slots(used: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """A first map with the slots that no record uses yet, dealt out in turn."""
    unused = used.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(used, "virtual_slot", "left_anti")
    return used.unionByName(unused.select(F.lit(0).alias("version"), "virtual_slot", F.pmod("virtual_slot", F.lit(shards)).cast("int").alias("shard"),
                                          F.lit(0).cast("long").alias("slot_bytes"), F.lit(0).cast("long").alias("slot_rows")))


def present_map(sizes: DataFrame, folder: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """The map in ``folder`` that holds for the present sizes: a first version where there is none, the latest one where it was made for the
    same sizes and shards, and else its rebalanced successor."""
    spark = sizes.sparkSession
    try:
        latest = load_map(spark, folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing.getCondition()):
            raise
        save_map(all_slots(first_map(sizes, shards), shards, slots), folder)
        return load_map(spark, folder)
    was, now = latest.select("virtual_slot", "slot_bytes", "slot_rows").where("slot_rows > 0"), sizes.select("virtual_slot", "slot_bytes", "slot_rows")
    same_shards = latest.select("shard").distinct().count() == shards and latest.where(F.col("shard") >= shards).isEmpty()
    if not (same_shards and was.exceptAll(now).isEmpty() and now.exceptAll(was).isEmpty()):
        save_map(cut_lineage(rebalance(latest, sizes, shards), "next_map"), folder)
        latest = load_map(spark, folder)
    return latest


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for ``shards`` shards and the present slot sizes.

    Only slots whose middle is above a shard's fair share move, in a fixed hash order, into the free space of the
    shards that lack more than the largest slot (or lack most); every other slot stays where it is.  Slots of shards that no
    longer exist move.
    """
    known = (current.select("version", "virtual_slot", "shard").join(sizes, "virtual_slot", "left")
             .fillna(0, ["slot_bytes", "slot_rows"]))
    total = known.agg(F.sum("slot_bytes").alias("_total"), F.max("slot_bytes").alias("_largest"))
    share = F.col("_total") / F.lit(float(shards))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = (known.withColumn("_total", F.sum("slot_bytes").over(Window.partitionBy(F.lit(1))))
              .withColumn("_sum", F.sum("slot_bytes").over(order)).withColumn("_move", (F.col("shard") >= shards) | (F.col("_sum") - F.col("slot_bytes") / 2 > share)))
    stay = placed.where("NOT _move")
    load = stay.groupBy("shard").agg(F.sum("slot_bytes").alias("_load"))
    spark = current.sparkSession
    room = (spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(load, "shard", "left").fillna(0, ["_load"])
            .join(total).withColumn("_free", F.greatest(share - F.col("_load"), F.lit(0.0)))
            .withColumn("_most", F.max("_free").over(Window.partitionBy(F.lit(1)))).where("_free > _largest OR _free = _most"))
    line = Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    room = room.withColumn("_to", F.sum("_free").over(line)).withColumn("_from", F.col("_to") - F.col("_free"))
    gaps = room.where("_free > 0").groupBy().agg(F.sort_array(F.collect_list(F.struct("_to", "shard"))).alias("_gaps"))
    queue = Window.partitionBy(F.lit(1)).orderBy(F.xxhash64("virtual_slot"), "virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    moving = (placed.where("_move").withColumn("_at", F.coalesce(F.sum("slot_bytes").over(queue), F.lit(0)) + F.col("slot_bytes") / 2).join(gaps))
    fit = F.filter("_gaps", lambda g: g["_to"] > F.col("_at"))
    target = F.coalesce(F.get(fit, F.lit(0))["shard"], F.element_at("_gaps", -1)["shard"])
    moved = moving.withColumn("shard", target)
    columns = [(F.col("version") + 1).alias("version"), "virtual_slot", "shard", "slot_bytes", "slot_rows"]
    return stay.select(*columns).unionByName(moved.select(*columns))


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Append one version to the store; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest by default."""
    stored = spark.read.schema("virtual_slot int, shard int, slot_bytes long, slot_rows long, version int").parquet(folder)
    if version is None:
        return stored.where(F.col("version") == stored.agg(F.max("version")).first()[0])
    return stored.where(F.col("version") == version)


def shard(docs: DataFrame, folder: str, shards: int = 24, *, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` and ``virtual_slot``.

    The law is ``bytes``: records are hashed into ``slots`` slots by key and text, bytes are summed by
    slot, and the map from slots to shards, kept in ``folder``, makes the shards' bytes near equal.  ``slot`` is the place
    of the row in its shard, without gaps: the rows of the shard's earlier virtual slots, then the order
    by key inside the virtual slot, so no shard is sorted in one task.  ``grown_shard`` is NULL under
    this law.  A folder that already holds a map keeps it: where sizes or the number of shards have changed since, ``rebalance`` edits it
    into its next version, and only the slots that it moves change their shard; ``docs`` are all records of the store.

    Size: bytes of the text plus 8 (NULL text: 8); NULL keys are hashed like any other.  Equal rows get
    places next to each other.  An empty table gives an empty table; input columns named as a result
    column are replaced.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")
    body, name = F.coalesce(column_like(docs, text), F.lit("")), column_like(docs, key)
    rows = docs.select(F.struct(*[column_like(docs, c) for c in docs.columns if c not in added]).alias("_row"), name.alias("_key"),
                       (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                       slot_of(name, body, slots=slots).alias("virtual_slot"))
    sizes = cut_lineage(slot_sizes(rows, "virtual_slot", "size"), "slot_sizes")
    now = present_map(sizes, folder, shards, slots)
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = (now.select("virtual_slot", "shard").join(F.broadcast(sizes), "virtual_slot").withColumn("_offset", F.coalesce(F.sum("slot_rows").over(earlier), F.lit(0)))
              .select("virtual_slot", "shard", "_offset"))
    inside = Window.partitionBy("virtual_slot").orderBy("_key", "text_crc32", "size")
    # The map has at most ``slots`` rows of three numbers, whatever the input.
    return (rows.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(placed), "virtual_slot")
            .select("_row.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_offset") + F.col("_n") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))
