"""Sharding by fixed virtual slots (DataFrame functions only).

A record's slot is a hash of its id and text over a fixed number of slots. Bytes are added up by slot, the
slots are dealt to shards, and that slot-to-shard map is stored with a version. Rebalancing and growing edit
the map: a record moves only when its slot is moved.

Cases: a null text has no bytes; null ids and repeated rows are records like any other; an empty table gives
an empty result; extra columns are not carried. Everything the map needs is a
table of ``slots`` rows, whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 4096
SHARDS = 16


def with_slot(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The record's id, its size (UTF-8 bytes of the text plus 1), the CRC-32 of its text, and its virtual slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(slotted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, records) of every slot, empty ones too: ``slots`` rows."""
    sums = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    every = slotted.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "records"])


def _deal(slots: DataFrame, shards: int, loads=None) -> DataFrame:
    """Deal slots, largest first, each to the shard with the fewest bytes so far; ``loads`` are bytes already placed."""
    order = "array_sort(collect_list(struct(-bytes AS less, virtual_slot)))"
    start = loads if loads is not None else f"array_repeat(0L, {shards})"
    least = "CAST(array_position(a.loads, array_min(a.loads)) - 1 AS INT)"
    fold = f"""aggregate(todo, named_struct('loads', {start}, 'shards', CAST(array() AS ARRAY<INT>)),
        (a, s) -> named_struct('loads', transform(a.loads, (x, i) -> IF(i = {least}, x - s.less, x)),
                               'shards', concat(a.shards, array({least}))))"""
    return (
        slots.groupBy().agg(F.expr(order).alias("todo"))
        .select(F.expr(f"arrays_zip(todo.virtual_slot, {fold}.shards)").alias("z"))
        .select(F.explode("z").alias("z"))
        .select(F.col("z").getField("virtual_slot").alias("virtual_slot"), F.col("z").getField("shards").alias("shard"))
    )


def new_map(by_slot: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: (version, virtual_slot, shard), near equal in bytes."""
    return _deal(by_slot, shards).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def _next(old: DataFrame, moved: DataFrame) -> DataFrame:
    """The old map with some slots moved, one version on."""
    return (
        old.join(moved.withColumnRenamed("shard", "to"), "virtual_slot", "left")
        .select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard"))
    )


def _excess(old: DataFrame, by_slot: DataFrame, goal) -> DataFrame:
    """Slots to take from shards above ``goal`` bytes: the largest whose sum stays within the shard's excess."""
    w = Window.partitionBy("shard")
    return (
        old.join(by_slot, "virtual_slot").join(by_slot.groupBy().agg(F.sum("bytes").alias("total")))
        .withColumn("over", F.sum("bytes").over(w) - goal)
        .withColumn("taken", F.sum("bytes").over(w.orderBy(F.desc("bytes"), "virtual_slot")))
        .where("bytes > 0 AND taken <= over")
    )


def grow_map(old: DataFrame, by_slot: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards + 1`` shards: slots move into the new shard and nowhere else."""
    goal = F.col("total") / F.lit(shards + 1)
    return _next(old, _excess(old, by_slot, goal).select("virtual_slot", F.lit(shards).alias("shard")))


def rebalance_map(old: DataFrame, by_slot: DataFrame, shards: int) -> DataFrame:
    """The next version after the bytes changed: only slots of overfull shards move, each to the least filled."""
    out = _excess(old, by_slot, F.col("total") / F.lit(shards)).select("virtual_slot", "bytes")
    kept = old.join(by_slot, "virtual_slot").join(out.select("virtual_slot"), "virtual_slot", "left_anti")
    every = old.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = (
        every.join(kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")), "shard", "left")
        .groupBy().agg(F.expr("transform(array_sort(collect_list(struct(shard, coalesce(bytes, 0L) AS bytes))), x -> x.bytes)").alias("start"))
    )
    order = "array_sort(collect_list(struct(-bytes AS less, virtual_slot)))"
    least = "CAST(array_position(a.loads, array_min(a.loads)) - 1 AS INT)"
    fold = f"""aggregate(todo, named_struct('loads', start, 'shards', CAST(array() AS ARRAY<INT>)),
        (a, s) -> named_struct('loads', transform(a.loads, (x, i) -> IF(i = {least}, x - s.less, x)),
                               'shards', concat(a.shards, array({least}))))"""
    moved = (
        out.groupBy().agg(F.expr(order).alias("todo")).join(loads)
        .select(F.explode(F.expr(f"arrays_zip(todo.virtual_slot, {fold}.shards)")).alias("z"))
        .select(F.col("z").getField("virtual_slot").alias("virtual_slot"), F.col("z").getField("shards").alias("shard"))
    )
    return _next(old, moved)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored maps."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest by default."""
    maps = spark.read.parquet(path)
    if version is None:
        maps = maps.join(maps.groupBy().agg(F.max("version").alias("version")), "version", "left_semi")
    else:
        maps = maps.where(F.col("version") == version)
    return maps.select(F.col("version").cast("int"), "virtual_slot", "shard")


def assign(slotted: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard and its place there, gapless from 0.

    Places come from the sizes of the slots before (a table of ``slots`` rows) and the order within a slot, so
    no shard is ever sorted as a whole.
    """
    counts = slotted.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("records"))
    ahead = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.join(counts, "virtual_slot", "left").select(
        "virtual_slot", "shard", F.coalesce(F.sum(F.coalesce("records", F.lit(0))).over(ahead), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("virtual_slot").orderBy(*[c for c in slotted.columns if c != "virtual_slot"])
    placed = slotted.withColumn("place", F.row_number().over(within) - 1)
    # the map has a row for each of the fixed number of slots
    return placed.join(F.broadcast(bases), "virtual_slot").withColumn("slot", F.col("base") + F.col("place")).drop("base", "place")
