"""Sharding by fixed virtual slots.

Every record is hashed into one of thousands of virtual slots; only slots are assigned to shards.
Bytes are summed per slot, so that planning works on a few thousand numbers whatever the size of
the corpus. The slot-to-shard map is a small versioned table. Rebalancing edits the map: it moves
whole slots from the fullest shards to the emptiest ones and leaves the others where they are.

Defined results: a record without text has size 1; without an id it is hashed by its text alone;
equal records (same id and text) share a virtual slot and stand side by side. An empty table gives
a map whose slots are dealt evenly. Other columns are not read. A shard can be heavier than the
mean by at most one record that is larger than a shard's share, or by a group of equal records.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from airmetrics.llm.common import stored

SLOTS = 4096
MAP_SCHEMA = T.StructType(
    [T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType())]
)


def with_slots(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes and one), ``text_crc32`` and ``virtual_slot`` per record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", crc), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_weights(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per virtual slot: at most as many numbers as there are slots."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return {row.virtual_slot: (row.bytes, row.rows) for row in sums.collect()}


def plan(weights: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Deal slots to shards, heaviest first, each to the lightest shard."""
    heap = [(0, 0, shard) for shard in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, count, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), count + 1, shard))
    return placed


def rebalance(
    placed: dict[int, int], weights: dict[int, int], shards: int, tolerance: float = 0.03
) -> dict[int, int]:
    """Edit a map for new weights or another number of shards, moving few slots.

    Slots of shards that no longer exist move first. Then, until the fullest and the emptiest
    shard differ by no more than ``tolerance`` of the mean or no slot fits between them, the slot
    that comes closest to halving their gap moves.
    """
    mean = sum(weights.values()) / shards
    edited = {slot: shard for slot, shard in placed.items() if shard < shards}
    held: dict[int, set[int]] = {shard: set() for shard in range(shards)}
    for slot, shard in edited.items():
        held[shard].add(slot)
    load = {shard: sum(weights.get(slot, 0) for slot in own) for shard, own in held.items()}

    def move(slot: int, shard: int) -> None:
        edited[slot] = shard
        held[shard].add(slot)
        load[shard] += weights.get(slot, 0)

    for slot in sorted(placed.keys() - edited.keys(), key=lambda s: (-weights.get(s, 0), s)):
        move(slot, min(load, key=lambda shard: (load[shard], shard)))
    for _ in range(len(edited)):
        full = max(load, key=lambda shard: (load[shard], -shard))
        empty = min(load, key=lambda shard: (load[shard], shard))
        gap = load[full] - load[empty]
        if gap <= tolerance * mean:
            break
        fitting = [slot for slot in held[full] if 0 < weights.get(slot, 0) < gap]
        if not fitting:
            break
        slot = min(fitting, key=lambda s: (abs(2 * weights[s] - gap), s))
        held[full].remove(slot)
        load[full] -= weights[slot]
        move(slot, empty)
    return edited


def map_frame(spark: SparkSession, placed: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(placed.items()), MAP_SCHEMA)


def save_map(spark: SparkSession, folder: str, version: int, placed: dict[int, int]) -> None:
    """Store a version of the map; a version that exists is never replaced."""
    map_frame(spark, placed).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}").collect()
    return {row.virtual_slot: row.shard for row in rows}


def assign(records: DataFrame, placed: dict[int, int], rows: dict[int, int]) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, without gaps from 0.

    Places are counted inside a virtual slot and shifted by the rows of the shard's earlier slots,
    so no task ever sorts a whole shard.
    """
    spark = records.sparkSession
    table, ahead = [], {}
    for slot, shard in sorted(placed.items()):
        table.append((slot, shard, ahead.get(shard, 0)))
        ahead[shard] = ahead.get(shard, 0) + rows.get(slot, 0)
    # As many rows as there are virtual slots, a fixed number.
    lookup = spark.createDataFrame(table, "virtual_slot int, shard int, ahead long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(order) - 1)
        .join(F.broadcast(lookup), "virtual_slot")
        .withColumn("slot", (F.col("ahead") + F.col("place")).cast("long"))
        .drop("place", "ahead")
    )


def shard_documents(documents: DataFrame, shards: int, slots: int = SLOTS, map_folder: str | None = None) -> DataFrame:
    """Hash, weigh, plan and place all records; ``map_folder`` stores the map as version 1."""
    records = stored(with_slots(documents, slots), "slots")
    weights = slot_weights(records)
    placed = plan({slot: size for slot, (size, _) in weights.items()}, shards, slots)
    if map_folder:
        save_map(documents.sparkSession, map_folder, 1, placed)
    return assign(records, placed, {slot: count for slot, (_, count) in weights.items()})
