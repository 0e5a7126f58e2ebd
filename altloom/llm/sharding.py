"""Sharding by fixed virtual slots.

A record's slot is a hash of its id and text checksum, one of a fixed number
of slots. Bytes are summed per slot, and a map gives each slot a shard: the
largest slots first, each to the shard with the fewest bytes so far. The map
has a row per slot and a version. It is stored, and edited rather than made
anew when shards are rebalanced or added: only slots that must move change
their shard, and a new version is written. A map has a place of its own, a
folder with a table per version; ``load`` gives the newest whole one, ``edit``
loads it, rebalances it for given totals and stores the next.

The map is as long as the number of slots, whatever the data; it is all that
comes to the driver. A row's place in its shard is the number of rows in the
shard's earlier slots plus its own place in its slot, so no shard is ordered
as a whole.

Nulls: a null text has 0 bytes and the checksum of the empty text; a null id
is hashed like a value. Equal rows get places next to each other. An empty
table gives an empty result and an even map.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from altloom.llm.base import read, whole
from altloom.session import materialize, shared_folder

SLOTS = 8192
SHARDS = 8
MAP = "virtual_slot int, shard int, version int"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every document."""
    rows = docs.select(
        "doc_id", (F.octet_length(whole("text")) + 1).cast("long").alias("size"),
        F.crc32(whole("text").cast("binary")).alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_totals(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use; a row per slot at most."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()
    return [tuple(r) for r in found]


def first_map(totals: list[tuple[int, int, int]], slots: int, shards: int) -> dict[int, int]:
    """Every slot in use to the shard with the fewest bytes when its turn comes, every other to that with the fewest slots."""
    size = dict.fromkeys(range(slots), 0) | {s: b for s, b, _ in totals}
    full, held, out = [0] * shards, [0] * shards, {}
    heap = [(0, 0, k) for k in range(shards)]
    used = sorted((s for s in size if size[s]), key=lambda s: (-size[s], s))
    for slot in used:
        _, _, shard = heapq.heappop(heap)
        out[slot] = shard
        full[shard], held[shard] = full[shard] + size[slot], held[shard] + 1
        heapq.heappush(heap, (full[shard], held[shard], shard))
    heap = [(held[k], k) for k in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(s for s in size if not size[s]):
        n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (n + 1, shard))
    return out


def rebalanced(old: dict[int, int], totals: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """An edited map: slots leave shards above the mean for shards below it, and no others move."""
    size = dict.fromkeys(old, 0) | {s: b for s, b, _ in totals}
    mean = sum(size.values()) / shards
    full = dict.fromkeys(range(shards), 0)
    for slot, shard in old.items():
        full[shard] = full.get(shard, 0) + size[slot]
    out = dict(old)
    for slot in sorted(old, key=lambda s: (-size[s], s)):
        least = min(range(shards), key=lambda k: (full[k], k))
        gone = out[slot] >= shards
        if gone or (full[out[slot]] - size[slot] >= mean and full[least] + size[slot] <= mean):
            full[out[slot]] -= size[slot]
            full[least] += size[slot]
            out[slot] = least
    return out


def stored(spark: SparkSession, slot_map: dict[int, int], place: str, version: int) -> DataFrame:
    """The map as a written table of one version."""
    rows = [(slot, shard, version) for slot, shard in sorted(slot_map.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{place}/map-{version}")  # a row per slot
    return spark.read.schema(MAP).parquet(f"{place}/map-{version}")


def versions(spark: SparkSession, place: str) -> list[int]:
    """The versions that have been written whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/map-*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(s.getPath().getParent().getName().removeprefix("map-")) for s in found or [])


def load(spark: SparkSession, place: str, version: int | None = None) -> tuple[dict[int, int], int]:
    """A map and its version, the newest if none is asked for."""
    version = versions(spark, place)[-1] if version is None else version
    rows = spark.read.schema(MAP).parquet(f"{place}/map-{version}").collect()
    return {r.virtual_slot: r.shard for r in rows}, version


def edit(spark: SparkSession, place: str, totals: list[tuple[int, int, int]], shards: int) -> int:
    """Rebalance the newest map for the given totals and number of shards; a map that changes is stored as the next version."""
    old, version = load(spark, place)
    new = rebalanced(old, totals, shards)
    if new == old:
        return version
    stored(spark, new, place, version + 1)
    return version + 1


def placed(rows: DataFrame, slot_map: dict[int, int], totals: list[tuple[int, int, int]]) -> DataFrame:
    """Add shard and slot, the row's place in its shard, gapless from 0."""
    counts = {s: n for s, _, n in totals}
    starts, used = [], {}
    for slot, shard in sorted(slot_map.items()):
        starts.append((slot, shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + counts.get(slot, 0)
    spark = rows.sparkSession
    table = spark.createDataFrame(starts, "of_slot int, shard int, first long")
    turn = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("turn", turn)
        .join(F.broadcast(table), F.col("virtual_slot") == F.col("of_slot"))
        .withColumn("slot", F.col("first") + F.col("turn"))
        .drop("of_slot", "first", "turn")
    )


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, place: str | None = None) -> DataFrame:
    """Every document with its shard and slot, by the map at ``place``; one is made where there is none, an older one is edited."""
    spark = docs.sparkSession
    place = place or f"{shared_folder(spark)}/altloom-map-{uuid.uuid4().hex}"
    rows = materialize(slotted(docs, slots))
    totals = slot_totals(rows)
    if versions(spark, place):
        edit(spark, place, totals, shards)
    else:
        stored(spark, first_map(totals, slots, shards), place, 1)
    return placed(rows, load(spark, place)[0], totals)


def op10_shards(spark, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
