"""Sharding by fixed virtual slots.

A record's key hashes to one of ``slots`` virtual slots, a number that never
changes.  Bytes are added up per slot (a table of at most ``slots`` rows) and a
versioned map gives each slot its shard: longest slots first, each to the
lightest shard.  Rebalancing edits the map: slots move, records are never
rehashed, and a new shard only receives.

Nulls: a null text has no bytes, a null key hashes like any other value.
Repeated rows share a slot.  An empty table gives an empty result and a map
that spreads the slots evenly.
"""

from __future__ import annotations

import heapq
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import int_array
from riskloom.session import checkpoint_dir

SLOTS = 4096
ROW_BYTES = 8


def virtual_slot(key, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_totals(df: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot of ``df(vslot, size)``: ``slots`` numbers each, whatever the input's size."""
    size, rows = [0] * slots, [0] * slots
    for r in df.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.vslot], rows[r.vslot] = r.b, r.n
    return size, rows


def build_map(size: list[int], shards: int) -> list[int]:
    """Slot-to-shard map: heaviest slot first, to the shard with fewest bytes (then fewest slots)."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * len(size)
    for slot in sorted(range(len(size)), key=lambda s: (-size[s], s)):
        b, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (b + size[slot], n + 1, shard))
    return out


def add_shard(mapping: list[int], size: list[int], shards: int) -> list[int]:
    """The map with shard number ``shards`` added: the heaviest shards give up
    slots until the new one has its even share; no other slot moves."""
    out = list(mapping)
    load = [0] * (shards + 1)
    own: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot in sorted(range(len(size)), key=lambda s: (size[s], s)):
        load[out[slot]] += size[slot]
        own[out[slot]].append(slot)
    share = sum(size) / (shards + 1)
    heap = [(-load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    while heap:
        _, s = heapq.heappop(heap)
        # its largest slot that still fits the new shard's share
        k = next((k for k in range(len(own[s]) - 1, -1, -1) if load[shards] + size[own[s][k]] <= share), None)
        if k is None or load[s] <= share:
            continue
        slot = own[s].pop(k)
        out[slot] = shards
        load[s] -= size[slot]
        load[shards] += size[slot]
        heapq.heappush(heap, (-load[s], s))
    return out


def map_frame(spark: SparkSession, mapping: list[int], size: list[int], rows: list[int], version: int) -> DataFrame:
    at = F.col("id").cast("int") + 1
    return spark.range(0, len(mapping), 1, 1).select(
        F.lit(version).alias("version"), F.col("id").cast("int").alias("slot"),
        F.element_at(int_array(mapping), at).alias("shard"),
        F.element_at(int_array(size, "bigint"), at).alias("bytes"),
        F.element_at(int_array(rows, "bigint"), at).alias("rows"))


def save_map(frame: DataFrame, path: str) -> None:
    """Add one version to the stored map; earlier versions stay."""
    version = frame.first()["version"]
    frame.drop("version").coalesce(1).write.parquet(os.path.join(path, f"version={version}"))


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.parquet(os.path.join(path, f"version={version}")).select("slot", "shard").collect()
    return [s for _, s in sorted((r.slot, r.shard) for r in rows)]


def shard(df: DataFrame, key: str, size: Column, shards: int, slots: int = SLOTS,
          map_path: str | None = None) -> DataFrame:
    """``df`` with ``vslot``, ``shard``, ``slot`` (its place in the shard, gapless
    from 0) and ``next_shard`` (by the edited map with one more shard).  ``df``
    must not already have these columns or ``size``.  Version 1 and 2 of the map
    are stored under ``map_path``."""
    spark = df.sparkSession
    path = map_path or os.path.join(checkpoint_dir(spark), "llm", f"slotmap-{uuid.uuid4().hex}")
    sized = df.withColumn("size", size).withColumn("vslot", virtual_slot(F.col(key), slots))
    by, rows = slot_totals(sized.select("vslot", "size"), slots)
    first = build_map(by, shards)
    save_map(map_frame(spark, first, by, rows, 1), path)
    save_map(map_frame(spark, add_shard(load_map(spark, path, 1), by, shards), by, rows, 2), path)
    now, later = load_map(spark, path, 1), load_map(spark, path, 2)
    before, seen = [0] * slots, [0] * shards
    for s in range(slots):      # rows of the shard in slots before this one
        before[s] = seen[now[s]]
        seen[now[s]] += rows[s]
    at = F.col("vslot") + 1
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(key, *[c for c in sized.columns if c not in (key, "vslot")]))
    return (sized.withColumn("slot", place - 1 + F.element_at(int_array(before, "bigint"), at))
            .withColumn("shard", F.element_at(int_array(now), at))
            .withColumn("next_shard", F.element_at(int_array(later), at)))
